"""Small fixtures for what SQL over the star schema doesn't reach."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import masking, registry, stats, text
from sparkloom.operators import analytics, flatten, joins, lookups, metrics, reconcile, retrieval, scoring, ticks
from sparkloom.plans import predicates
from sparkloom.sources import readers, schemas, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("n", "c", "k", "want"), [(1, 1, 1, 1.0), (1, 0, 1, 0.0), (2, 1, 1, 0.5), (2, 1, 2, 0.0), (4, 3, 2, 0.5), (1, 1, 2, None), (60, 59, 30, 0.5)])
def test_pass_hat(spark, n, c, k, want):
    got = one(spark, stats.pass_hat(F.lit(n), F.lit(c), k))
    assert got == pytest.approx(want) if want is not None else got is None


def test_pass_hat_can_raise(spark):
    with pytest.raises(Exception, match="fewer than 2"):
        one(spark, stats.pass_hat(F.lit(1), F.lit(1), 2, short="raise"))


def test_rewards_near_one_count(spark):
    got = spark.createDataFrame([(1 - 1e-7,), (1 + 1e-7,), (0.9,), (None,)], "r double").select(stats.is_success("r").alias("s")).collect()
    assert [r.s for r in got] == [True, True, False, False]


def test_correlation_of_odd_groups(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, 5.0), ("b", 1.0, 3.0), ("c", 0.1, 1.0), ("c", 0.1, 2.0), ("c", 0.1, 7.0), ("d", float("nan"), 1.0), (None, 1.0, 2.0), (None, 2.0, 1.0)]
    got = {r.k: r.r for r in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(stats.correlation("x", "y").alias("r")).collect()}
    assert got["a"] == pytest.approx(1.0) and got[None] == pytest.approx(-1.0)
    assert got["b"] is None and got["c"] is None and got["d"] is None


RECORDS = [("u1", "5000.00", 30, ["x", "y"]), ("u2", "150.00", None, ["y"]), ("u3", None, 41, None)]


@pytest.mark.parametrize(
    ("constraints", "want"),
    [
        ({}, ["u1", "u2", "u3"]),
        ({"balance__gt": "2"}, ["u1"]),  # text compares as text
        ({"balance__gt": 2}, []),  # unlike types never match
        ({"age": None}, ["u2"]),
        ({"age__ne": 30}, ["u2", "u3"]),
        ({"tags__contains": "x"}, ["u1"]),
        ({"age__in": [30, None]}, ["u1", "u2"]),
        ({"age__nin": [30]}, ["u2", "u3"]),
        ({"missing__ne": 1}, ["u1", "u2", "u3"]),
        ({"missing": 1}, []),
        ({"id__in": "u1,u2"}, ["u1", "u2"]),  # membership in a text is a substring test
        ({"age__nosuch": 30}, ["u1"]),
        ({"id__endswith": 3}, ["u3"]),
    ],
)
def test_constraints(spark, constraints, want):
    df = spark.createDataFrame(RECORDS, "id string, balance string, age int, tags array<string>")
    assert sorted(r.id for r in predicates.query(df, constraints).collect()) == want


def test_limit_zero_still_gives_one(spark):
    df = spark.createDataFrame(RECORDS, "id string, balance string, age int, tags array<string>")
    assert predicates.query(df, {}, "id", limit=0).count() == 1
    assert [r.id for r in predicates.query_json(df, '{"limit": 2, "return_ids": true}', "id").collect()] == ["u1", "u2"]
    with pytest.raises(ValueError):
        predicates.query_json(df, "[1]")


def transcript_by_definition(own, other, gap, barriers):
    """Each word's place from the rules alone, by comparing every segment to every other."""

    def cut(words):
        segments = []
        for t in sorted(words):
            parted = not segments or t - segments[-1][-1] > gap or any(segments[-1][-1] <= b < t for b in barriers)
            segments.append([t]) if parted else segments[-1].append(t)
        return segments

    def inside(small, large):
        return large[0] <= small[0] and small[-1] <= large[-1] and (small[0], small[-1]) != (large[0], large[-1])

    mine, theirs = cut(own), cut(other)
    placed = []
    for words, segments, across, role, priority in ((own, mine, theirs, "assistant", 1), (other, theirs, mine, "user", 0)):
        for number, segment in enumerate(segments):
            begin = segment[-1] + 0.25 if any(inside(segment, x) for x in across) else segment[0]
            for t in segment:
                passed = [x[-1] for x in across if inside(x, segment) and x[-1] < t]
                placed.append((max(passed) + 0.5 if passed else begin, priority, number, t, role, words[t]))
    out, before = [], None
    for place, priority, number, _, role, word in sorted(placed):
        if (place, priority, number) == before:
            out[-1] = role, out[-1][1] + word
        else:
            out.append((role, word))
        before = place, priority, number
    return out


@pytest.mark.parametrize("gap", [1, 2, 4])
def test_transcripts_of_random_ticks_follow_the_rules(gap):
    r = random.Random(gap)
    for _ in range(1500):
        n, talk = r.randint(0, 14), r.choice([0.2, 0.5, 0.8])
        own, other = ({t: f"{side}{t} " for t in range(n) if r.random() < talk} for side in "ab")
        barriers = [t for t in range(n) if r.random() < 0.15]
        assert ticks.linearize(own, other, gap=gap, barriers=barriers) == transcript_by_definition(own, other, gap, barriers), (own, other, barriers)


@pytest.mark.parametrize(
    ("own", "other", "gap", "barriers", "want"),
    [
        ("", "", 1, [], []),
        ("x", "x", 1, [], ["b0", "a0"]),  # a tie: the other side first
        ("xxxxx", "..x..", 1, [], ["a0a1a2", "b2", "a3a4"]),  # one inside another is put behind the part it ends with
        ("xxxxxx", ".x..x.", 1, [], ["a0a1", "b1", "a2a3a4", "b4", "a5"]),  # two inside one
        ("..x..", "xxxxx", 1, [], ["b0b1b2", "a2", "b3b4"]),  # the same the other way
        ("xxx", "xxx", 1, [], ["b0b1b2", "a0a1a2"]),  # the same ticks: neither lies inside
        ("xxx..", "..xxx", 1, [], ["a0a1a2", "b2b3b4"]),  # partial overlap: by start
        ("x..x", "", 2, [], ["a0", "a3"]),  # further apart than the gap
        ("x..x", "", 3, [], ["a0a3"]),
        ("xx", "", 1, [0], ["a0", "a1"]),  # a tool call ends a segment
        ("xxxx", ".xx.", 1, [1], ["a0a1", "b1", "a2", "b2", "a3"]),  # a tool call parts both sides
    ],
)
def test_linear_transcripts(own, other, gap, barriers, want):
    a, b = ({t: f"{name}{t}" for t, c in enumerate(side) if c == "x"} for name, side in (("a", own), ("b", other)))
    assert [text for _, text in ticks.linearize(a, b, gap=gap, barriers=barriers)] == want


def test_bm25_scans_texts_twice_and_splits_common_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(["the"] * (k % 3 + 1) + [f"w{k % 5}", "Fox"][: 1 + k % 2])) for k in range(40)] + [(99, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "the fox"), (2, "w1 w1 nothing"), (3, " ")], "q long, text string")
    index = retrieval.Bm25Index(docs, "id", "text")
    plan = index.scores(queries, "q", "text")
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("explode(__t") == 1 and "BroadcastNestedLoop" not in shown  # one pass here, one in the index
    few = sorted((r.q, r.id, round(r.score, 9)) for r in plan.collect())
    monkeypatch.setattr(retrieval, "ASKED", 0)
    assert sorted((r.q, r.id, round(r.score, 9)) for r in index.scores(queries, "q", "text").collect()) == few
    assert {q for q, _, _ in few} == {1, 2} and len([1 for q, _, _ in few if q == 1]) == 40


def test_other_strategies():
    own, other = {0: "a", 2: "b", 6: "e"}, {1: "c", 2: "d"}
    assert ticks.linearize(own, other, "self_first") == [("assistant", "a"), ("user", "c"), ("assistant", "b"), ("user", "d"), ("assistant", "e")]
    assert ticks.linearize(own, other, "other_first") == [("assistant", "a"), ("user", "cd"), ("assistant", "be")]
    assert ticks.linearize(own, other, "consolidated") == [("user", "cd"), ("assistant", "abe")]
    assert ticks.linearize(own, {}, barriers=[1], gap=5) == [("assistant", "a"), ("assistant", "be")]
    with pytest.raises(ValueError):
        ticks.linearize(own, other, "nosuch")


def test_transcripts_by_conversation(spark):
    rows = [(1, 0, "a", None, None), (1, 1, None, "b", None), (2, 0, None, None, "tool"), (2, 1, "c", "d", None)]
    df = spark.createDataFrame(rows, "conv long, tick int, own string, other string, tool string")
    got = sorted(map(tuple, ticks.linear_transcript(df, "conv", "tick", "own", "other", tool="tool").collect()))
    assert got == [(1, 0, "assistant", "a"), (1, 1, "user", "b"), (2, 0, "user", "d"), (2, 1, "assistant", "c")]


def test_silence_runs_to_the_end(spark):
    df = spark.createDataFrame([(1, k, w, None) for k, w in enumerate(["a", None, None, "b", None, None, None])], "conv long, tick int, own string, other string")
    got = sorted((r.first, r.last, r.length) for r in ticks.silences(df, ["conv"], "tick", ["own", "other"], 2).collect())
    assert got == [(2, 3, 2), (5, 7, 3)]


def test_intervals_close_last_in_first_out(spark):
    rows = [(1, 1, "o"), (1, 2, "o"), (1, 3, "c"), (1, 4, "o"), (1, 5, "c"), (1, 6, "c"), (1, 7, "o")]
    df = spark.createDataFrame(rows, "k long, at long, kind string")
    got = sorted((r.at, r.closed_at) for r in ticks.close_intervals(df, ["k"], "at", F.col("kind") == "o", F.col("kind") == "c", F.lit(99).cast("long")).collect())
    assert got == [(1, 6), (2, 3), (4, 5), (7, 99)]


CALL = "struct<name:string,args:map<string,string>>"
GOLD = "struct<name:string,args:map<string,string>,compare_args:array<string>>"


@pytest.mark.parametrize(
    ("gold", "call", "want"),
    [
        (("f", {"a": "1"}, None), ("f", {"a": "1"}), True),
        (("f", {"a": "1", "b": "2"}, None), ("f", {"a": "1"}), True),  # arguments only gold has don't count
        (("f", {"a": "1"}, None), ("f", {}), True),  # a call without arguments fits any
        (("f", {"a": "1"}, None), ("f", {"a": "2"}), False),
        (("f", {"a": "1", "b": "2"}, ["a"]), ("f", {"a": "1", "b": "9"}), True),
        (("f", {"a": "1"}, ["a"]), ("f", {}), False),
        (("f", {"a": "1"}, []), ("f", {"a": "9"}), True),
        (("f", {}, None), ("g", {}), False),
    ],
)
def test_calls_match_gold_actions(spark, gold, call, want):
    df = spark.createDataFrame([(gold, call)], f"g {GOLD}, c {CALL}")
    assert df.select(scoring.call_matches(F.col("g"), F.col("c")).alias("m")).first().m is want


def test_rewards(spark):
    df = spark.createDataFrame([([], [], ["a,b"], ["A,b"], ["DB", "ACTION"], {"DB": 1.0, "ACTION": 0.5}, "user_stop")], f"golds array<{GOLD}>, calls array<{CALL}>, needles array<string>, said array<string>, basis array<string>, parts map<string,double>, end string")
    got = df.select(scoring.action_reward("golds", "calls"), scoring.communication_reward("needles", "said"), scoring.combined_reward("basis", "parts", "end"), scoring.combined_reward("basis", "parts", F.lit("max_steps"))).first()
    assert list(got) == [1.0, 0.0, 0.5, 0.0]  # a needle with a comma is never said
    with pytest.raises(Exception, match="not evaluated"):
        df.select(scoring.combined_reward(F.array(F.lit("NL")), "parts", "end")).collect()


def test_state_replay(spark):
    rows = [("s", 1, "set", "a", "1"), ("s", 2, "add", "n", "2"), ("s", 3, "add", "n", "x"), ("s", 4, "delete", "a", None), ("t", 1, "add", "n", "2")]
    df = spark.createDataFrame(rows, "sim string, n int, op string, key string, value string")
    got = {r.sim: r for r in scoring.replay_states(df, "sim", "n", "op", "key", "value").collect()}
    assert json.loads(got["s"].state) == {"n": 2.0} and got["s"].failed_calls == 1
    assert got["s"].state_hash == got["t"].state_hash
    same = scoring.state_reward(df.sparkSession.createDataFrame([("s", "h"), ("u", "h")], "sim string, state_hash string"), df.sparkSession.createDataFrame([("s", "h")], "sim string, state_hash string"), "sim")
    assert {r.sim: r.db_reward for r in same.collect()} == {"s": 1.0, "u": 0.0}


def test_severities(spark):
    rows = [("a", 0, "agent", "minor", None, 3), ("a", 1, "user", "critical", None, 5), ("a", 2, "agent", "critical", 4, 9), ("b", 0, "agent", None, None, None), ("c", 0, "user", "critical_helped", None, None)]
    df = spark.createDataFrame(rows, "sim string, idx int, source string, severity string, tick_start int, turn_idx int")
    assert {r.sim: r.worst for r in metrics.worst_severity(df, "sim").collect()} == {"a": "critical", "b": "none", "c": "critical_helped"}
    assert {r.sim: r.first_critical for r in metrics.first_critical_source(df, "sim").collect()} == {"a": "agent", "b": "none", "c": "user"}


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(k % 5)) for k in range(50)] + [("one", 3.0), ("gone", None)], "g string, x double")
    got = {r.g: r for r in analytics.bootstrap_means(df, ["g"], "x", 300).collect()}
    assert got["one"].ci_low == got["one"].ci_high == 3.0
    assert all(math.isnan(x) for x in (got["gone"].estimate, got["gone"].ci_low, got["gone"].ci_high))
    assert got["a"].ci_low < got["a"].estimate == 2.0 < got["a"].ci_high
    again = analytics.bootstrap_means(df.repartition(7), ["g"], "x", 300).collect()
    assert {r.g: str(r.ci_low) for r in again} == {g: str(r.ci_low) for g, r in got.items()}  # nan as text


def test_bm25_equals_the_formula(spark):
    import math

    docs = {1: "a b a", 2: "b c", 3: "b d e f", 4: "", 5: "A x"}
    index = retrieval.Bm25Index(spark.createDataFrame(list(docs.items()), "id long, text string"), "id", "text")
    got = {(r.q, r.id): r.score for r in index.scores(spark.createDataFrame([(1, "a B zzz"), (2, " ")], "q long, t string"), "q", "t").collect()}
    words = {k: v.lower().split() for k, v in docs.items()}
    terms = {w for ws in words.values() for w in ws}
    df = {t: sum(t in ws for ws in words.values()) for t in terms}
    idf = {t: math.log((5 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    length = sum(map(len, words.values())) / 5
    want = {}
    for k, ws in words.items():
        if set(ws) & {"a", "b"}:
            want[1, k] = sum(idf[t] * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / length)) for t in ("a", "b"))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_tokens_split_at_unicode_space(spark):
    odd = "a" + chr(0xA0) + "b" + chr(0x3000) + "C\n"
    assert one(spark, retrieval.tokens(F.lit(odd))) == ["a", "b", "c"]


def test_masking_and_arithmetic():
    pattern = masking.term_pattern(["cat", "cat food", "a+b"])
    masked, found = masking.mask_text("cat food, cats, cat and a+b", pattern)
    assert found == ["cat food", "cat", "a+b"] and masked == "[[0]], cats, [[1]] and [[2]]"
    assert masking.unmask_text(masked, found) == "cat food, cats, cat and a+b"
    with pytest.raises(ValueError):
        masking.unmask_text("[[0]]", found)
    assert masking.calculate_text("2 * (3 + 4) / 5") == 2.8
    for bad in ("2 ** 9", "__import__('os')", "1 +", ""):
        with pytest.raises((ValueError, SyntaxError)):
            masking.calculate_text(bad)


def test_text_functions(spark):
    assert one(spark, text.language_code(F.lit(" __label__zh-Hans"))) == "zh"
    assert one(spark, text.product_of(F.array(F.lit(0.5), F.lit(None), F.lit(0.5)))) == 0.25
    assert one(spark, text.says(F.lit("1,000 Dollars"), F.lit("1000 DOLLARS"))) is True
    assert one(spark, text.slug(F.lit("  Über & Out! "))) == "ber-out"
    assert one(spark, text.slug(F.lit("!!"))) == "section"
    assert one(spark, F.to_json(text.from_fence(F.lit('x ```json\n{"a": 1}\n``` y')))) == '{"a":1}'
    assert one(spark, text.spoken_turn(F.lit("###STOP###"))) is False
    assert one(spark, text.turn_number(F.lit(0), F.lit(7), zero_counts=False)) == 7
    assert one(spark, text.turn_number(F.lit(0), F.lit(7), zero_counts=True)) == 0
    assert one(spark, F.regexp_extract(F.lit("Hi Bob!"), text.template_pattern("Hi {name}!"), 1)) == "Bob"
    with pytest.raises(Exception, match="no match"):
        one(spark, text.group_or_raise(F.lit("abc"), r"(\d+)"))


SIM = {
    "id": "s1", "task_id": "t1", "trial": 0, "duration": 1.5, "termination_reason": "user_stop", "agent_cost": 0.1,
    "reward_info": {"reward": 1.0, "db_check": {"db_match": True}, "reward_basis": ["DB"], "reward_breakdown": {"DB": 1.0}, "action_checks": [{"action": {"name": "pay", "requestor": "assistant"}, "action_match": True, "tool_type": "write"}]},
    "messages": [{"role": "user", "content": "b", "timestamp": "2", "cost": 1.0}, {"role": "assistant", "content": "a", "timestamp": "1"}],
    "review": {"errors": [{"source": "odd", "severity": None, "error_tags": ["x"]}]},
}
TASK = {"id": "t1", "evaluation_criteria": {"actions": [{"name": "Transfer_to_human", "requestor": "assistant"}], "nl_assertions": ["x"]}}


@pytest.fixture(scope="module")
def runs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    (folder / "one").mkdir()
    (folder / "one" / "results.json").write_text(json.dumps({"timestamp": "x", "info": {"num_trials": 1}, "tasks": [TASK], "simulations": [SIM]}, indent=1))
    (folder / "two" / "simulations").mkdir(parents=True)
    (folder / "two" / "results.json").write_text(json.dumps({"info": {"num_trials": 1}, "tasks": [TASK]}, indent=1))
    (folder / "two" / "simulations" / "s1.json").write_text(json.dumps(SIM, indent=1))
    return str(folder)


@pytest.mark.parametrize("layout", ["one", "two"])
def test_runs_in_both_formats(spark, runs, layout):
    path = f"{runs}/{layout}/results.json"
    sims = readers.read_simulations(spark, path)
    assert readers.results_format(spark, path) == ("json" if layout == "one" else "dir")
    assert [tuple(r) for r in sinks.simulation_index(sims).collect()] == [("s1", "t1", 0, 1.0, "user_stop", 0.1, 1.5)]
    assert [m.content for m in flatten.ordered_messages(sims).first().messages] == ["a", "b"]
    flags = flatten.reward_flags(sims, ["pay"]).first()
    assert (flags.db_met, flags.action_met, flags.num_writes, flags.num_writes_met) == (True, None, 1, 1)
    assert [(r.name, r.matched, r.kind) for r in flatten.action_check_rows(sims).collect()] == [("pay", True, "write")]
    assert [(r.idx, r.source) for r in flatten.review_errors(sims).collect()] == [(0, "agent")]
    assert flatten.simulation_rows(sims).first().num_messages == 2
    tasks = readers.read_metadata(spark, path).select(F.explode("tasks").alias("t")).select("t.*")
    assert flatten.task_metrics(tasks).first().num_actions == -1
    saved = sinks.trimmed(sims, ["cost", "timestamp"], ["ticks"]).first()
    assert saved.saved_bytes > 0 and "ticks" not in saved.asDict()


def test_writers_round_trip(spark, runs, tmp_path):
    sims = readers.read_simulations(spark, f"{runs}/one/results.json")
    sinks.write_results(sims, f"{tmp_path}/a", "json")
    assert spark.read.schema(schemas.fields(schemas.SIMULATION)).json(f"{tmp_path}/a").first().id == "s1"
    rows = spark.createDataFrame([("x", 1 / 3), ("y", float("nan")), ("z", None)], "k string, v double")
    sinks.write_csv(rows, f"{tmp_path}/b", 6)
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/b").collect()), key=str) == [("x", "0.333333"), ("y", None), ("z", None)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.append_new(old, new, ["k"]).collect())) == [(3, "d")]


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "a.toml").write_text("x = 1\n[t]\ny = 'z'\n")
    (tmp_path / "a.md").write_text("# One\ntext\n## Two\nmore\n## Two\nend")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "1.json").write_text(json.dumps({"id": "d", "title": "old", "content": "c"}))
    (tmp_path / "docs" / "2.json").write_text(json.dumps({"id": "d", "title": "new", "content": "c"}))
    (tmp_path / "run.log").write_text("10 start vad=3\nnoise\n11 stop\n")
    (tmp_path / "e.csv").write_text("simulation_source,scenario,domain,language,model,num_tasks,num_simulations,pass_1,pass_2,pass_3,rho\na, X ,D,en,m,3,x,0.5,,,\n ,y,d,en,m,1,1,1,1,1,1\n")
    assert json.loads(readers.read_any(spark, f"{tmp_path}/a.toml").select(F.to_json("record").alias("j")).first().j) == {"x": 1, "t": {"y": "z"}}
    md = readers.read_any(spark, f"{tmp_path}/a.md").withColumn("k", F.lit(1))
    assert [r.section_id for r in flatten.markdown_sections(md, "k", "value").orderBy("section_id").collect()] == ["001_one_1", "002_two_1", "003_two_2"]
    assert [(r.id, r.title) for r in readers.read_corpus(spark, f"{tmp_path}/docs").collect()] == [("d", "new")]
    assert [(r.event, r.detail) for r in readers.read_log_events(spark, f"{tmp_path}/run.log", {"vad": r"vad=(\d+)", "stop": r"(\d+) stop"}).collect()] == [("vad", "3"), ("stop", "11")]
    row = readers.read_experiments(spark, f"{tmp_path}/e.csv").collect()
    assert [(r.scenario, r.num_tasks, r.num_simulations, r.pass_1) for r in row] == [("x", 3.0, None, 0.5)]
    assert readers.read_files(spark, [str(tmp_path)], ".md").count() == 1
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.exe")


def test_run_names(spark):
    df = spark.createDataFrame([("gpt-4_airline_base_gpt-4_3trials_50tasks.json",), ("other.txt",)], "file_name string").withColumns(readers.run_name_parts())
    assert [tuple(r)[1:] for r in df.collect()] == [("gpt-4", "airline", "base", "gpt-4", 3, 50), (None,) * 6]


def test_string_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": ["x", 2, {"b": "yz"}], "c": null}'), (2, "not json"), (3, None)], "k long, j string")
    assert sorted(map(tuple, flatten.string_leaves(df, "k", "j").collect())) == [(1, "a/0", "x"), (1, "a/2/b", "yz")]
    assert [tuple(r) for r in flatten.leaf_totals(df, "k", "j").collect()] == [(1, 2, 3)]


def test_lookups(spark):
    flights = spark.createDataFrame([("F1", "PHL", "LGA", "06:00", {"2024-05-16": ("available", 3)}), ("F2", "PHL", "LGA", "09:00", {"2024-05-16": ("landed", 0)})], "flight string, origin string, destination string, departs string, dates map<string,struct<status:string,seats:int>>")
    assert [r.flight for r in lookups.direct_flights(flights, "2024-05-16", "PHL", "LGA").collect()] == ["F1"]
    assert lookups.direct_flights(flights, "2024-05-17").count() == 0
    customers = spark.createDataFrame([("C1", "1", ["L1"]), ("C2", "2", ["L2"])], "customer_id string, phone_number string, line_ids array<string>")
    lines = spark.createDataFrame([("L1", "9"), ("L2", "8")], "line_id string, phone_number string")
    assert [lookups.by_any_phone(customers, lines, p, "customer_id").first().customer_id for p in ("1", "8")] == ["C1", "C2"]
    assert one(spark, lookups.billing_end(F.lit("2024-12-05").cast("date"))).isoformat() == "2024-01-05"
    assert one(spark, lookups.next_day(F.lit("2024-05-31"), F.lit("01:00+1"))) == "2024-06-01"
    with pytest.raises(ValueError):
        lookups.by_key(customers, "customer_id", "C9", require=True)


def test_assigned_segments(spark):
    segments = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 8, 9)], "k long, n int, s int, e int")
    points = spark.createDataFrame([(1, 3), (1, 6), (1, 20)], "k long, at int")
    assert sorted((r.at, r.n) for r in joins.assign_segment(points, segments, ["k"], "at", "s", "e", "n").collect()) == [(3, 0), (6, 1), (20, 1)]


def test_missing_dimension_raises(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    assert joins.lookup(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="no match"):
        joins.lookup(left, right, ["k"], require=True).collect()


def test_tools_and_detectors(spark):
    tools = registry.ToolCatalog()

    @tools.tool("read")
    def shout(x: str) -> str:
        return x.upper()

    @tools.tool("write", hidden=True)
    def erase(x: str) -> str:
        return ""

    assert tools.writes() == []
    tools.unlock("erase")
    assert tools.writes() == ["erase"] and tools.frame(spark).count() == 2
    tools.register_sql(spark)
    assert spark.sql("SELECT shout('a') AS x").first().x == "A"
    detect = registry.batched(lambda: lambda texts: ["de" if "ü" in t else "en" for t in texts])
    rows = spark.createDataFrame([("für",), ("for",), (" ",), (None,)], "t string").select(detect("t").alias("x")).collect()
    assert [r.x for r in rows] == ["de", "en", None, None]
    with pytest.raises(KeyError):
        registry.retrievers.get("nosuch")


def test_quotas_are_met(spark):
    from sparkloom.operators import sampling

    rows = spark.range(1000).withColumnRenamed("id", "k")
    got = {r.choice: r["count"] for r in sampling.quota_blocks(rows, ["k"], {"a": 0.5, "b": 0.3, "c": 0.2}, 3, bins=16).groupBy("choice").count().collect()}
    assert got == {"a": 500, "b": 300, "c": 200}


def test_fingerprints_tell_tables_apart_and_count_repeats(spark):
    def of(rows):
        return {r.g: (r.rows, r.fingerprint) for r in reconcile.fingerprints(spark.createDataFrame(rows, "g string, a long, b string"), "g", ["a", "b"]).collect()}

    rows = [("x", 1, "p"), ("x", 2, None), ("x", 2, None), ("y", 1, "p"), (None, 3, "")]
    first = of(rows)
    assert of(rows[::-1]) == first and {g: n for g, (n, _) in first.items()} == {"x": 3, "y": 1, None: 1}
    assert of([("x", 1, "p"), ("x", 1, "p"), ("x", 2, None)])["x"] != first["x"]
    assert of([("x", 1, "p"), ("x", 2, None)])["x"][1] != first["x"][1]
    assert of([("x", 1, "p"), ("x", 2, ""), ("x", 2, None)])["x"] != first["x"] and of([]) == {}
