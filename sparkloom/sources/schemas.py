"""Explicit schemas of run traces; nothing is inferred from data."""

from __future__ import annotations

TOOL_CALL = "STRUCT<id: STRING, name: STRING, requestor: STRING, arguments: STRING>"
MESSAGE = f"STRUCT<role: STRING, content: STRING, turn_idx: INT, timestamp: STRING, cost: DOUBLE, id: STRING, error: BOOLEAN, tool_calls: ARRAY<{TOOL_CALL}>>"
TICK = f"STRUCT<tick_id: INT, timestamp: STRING, agent_chunk: {MESSAGE}, user_chunk: {MESSAGE}, agent_tool_results: ARRAY<{MESSAGE}>, user_tool_results: ARRAY<{MESSAGE}>>"
ACTION_CHECK = "STRUCT<action: STRUCT<action_id: STRING, requestor: STRING, name: STRING, arguments: STRING>, action_match: BOOLEAN, action_reward: DOUBLE, tool_type: STRING>"
REWARD = f"STRUCT<reward: DOUBLE, db_check: STRUCT<db_match: BOOLEAN, db_reward: DOUBLE>, action_checks: ARRAY<{ACTION_CHECK}>, reward_basis: ARRAY<STRING>, reward_breakdown: MAP<STRING, DOUBLE>>"
ERROR = "STRUCT<source: STRING, severity: STRING, error_tags: ARRAY<STRING>, turn_idx: INT, tick_start: INT>"
REVIEW = f"STRUCT<errors: ARRAY<{ERROR}>>"
SIMULATION = f"STRUCT<id: STRING, task_id: STRING, trial: INT, seed: INT, start_time: STRING, end_time: STRING, duration: DOUBLE, termination_reason: STRING, agent_cost: DOUBLE, user_cost: DOUBLE, reward_info: {REWARD}, messages: ARRAY<{MESSAGE}>, ticks: ARRAY<{TICK}>, review: {REVIEW}, user_only_review: {REVIEW}>"
ACTION = "STRUCT<action_id: STRING, requestor: STRING, name: STRING, arguments: STRING, compare_args: ARRAY<STRING>>"
TASK = f"STRUCT<id: STRING, evaluation_criteria: STRUCT<actions: ARRAY<{ACTION}>, env_assertions: ARRAY<STRING>, communicate_info: ARRAY<STRING>, nl_assertions: ARRAY<STRING>, reward_basis: ARRAY<STRING>>>"
INFO = "STRUCT<git_commit: STRING, num_trials: INT, max_steps: INT, max_errors: INT, seed: INT, environment_info: STRUCT<domain_name: STRING>, agent_info: STRUCT<implementation: STRING, llm: STRING, llm_args: STRING>, user_info: STRUCT<implementation: STRING, llm: STRING, llm_args: STRING>, lang_id: STRING, lang_components: ARRAY<STRING>>"
INDEX = "STRUCT<id: STRING, task_id: STRING, trial: INT, reward: DOUBLE, termination_reason: STRING, agent_cost: DOUBLE, duration: DOUBLE>"


def fields(struct: str) -> str:
    """A struct's fields as a schema for a reader: without the colons after its own names."""
    out, depth = [], 0
    for c in struct.removeprefix("STRUCT<").removesuffix(">"):
        depth += (c == "<") - (c == ">")
        if c != ":" or depth:
            out.append(c)
    return "".join(out)


RESULTS = f"timestamp STRING, info {INFO}, tasks ARRAY<{TASK}>, simulations ARRAY<{SIMULATION}>, simulation_index ARRAY<{INDEX}>"
METADATA = f"timestamp STRING, info {INFO}, tasks ARRAY<{TASK}>, simulation_index ARRAY<{INDEX}>"
EXPERIMENTS = "simulation_source STRING, scenario STRING, domain STRING, language STRING, model STRING, num_tasks STRING, num_simulations STRING, pass_1 STRING, pass_2 STRING, pass_3 STRING, rho STRING"
