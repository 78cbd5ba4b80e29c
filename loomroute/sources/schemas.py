"""Declared schemas of the plan-data files; nothing is inferred."""

STEP = "struct<product:string,reactants:array<string>>"
#: A run: one row a target, with its routes and the stamps at which they were found.
RUN = f"target string, algo string, routes array<array<{STEP}>>, found_at_calls array<double>, n_routes int, solved boolean, calls int, stop_reason string, error string"
#: A pooled route.
POOLED = f"target string, steps array<{STEP}>, sources array<array<string>>, found_at_calls double, first_rank int, pareto_rank int, sft_candidate boolean"
#: A board run.
BOARD = f"target string, routes array<struct<steps:array<{STEP}>,found_at_calls:double,found_at_unique:double,found_at_episode:int>>, routes_union array<struct<steps:array<{STEP}>,found_at_calls:double,found_at_unique:double,found_at_episode:int>>"
#: A menu cache: product -> list of (reactants, confidence), kept as text pairs.
MENU = "map<string,array<struct<reactants:array<string>,q:double>>>"
#: An episode of messages.
EPISODE = "target string, harmony_messages array<struct<role:string,channel:string,recipient:string,content_type:string,name:string,content:string,supervised:boolean>>"
PRICE = "smi_can string, price string"
