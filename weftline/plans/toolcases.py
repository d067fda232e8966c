"""Tool definitions, calls and dialogues as texts, on tables of cases dealt to the rows of `conversations` in turn."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions import dialogue as D
from weftline.functions import structure, tools
from weftline.plans.common import table

canonical = structure.canonical


def reason(rule: Callable, *args):
    """What the rule gives, or "stage/reason" of its rejection."""
    try:
        return rule(*args)
    except D.Rejected as e:
        return f"{e.stage}/{e.reason}"


def listed(rule: Callable):
    """The rule's result as canonical JSON, or the rejection."""

    def apply(x: str) -> str:
        out = reason(rule, x)
        return out if isinstance(out, str) else canonical(out)

    return apply


def tool_lines(x: str):
    events: list = []
    return [[t["function"]["name"], t["function"]["parameters"]] for t in D.tools(x.split("\n"), events)] + [sorted(e[1] for e in events)]


def turns(x: str):
    return [[m["role"], m["content"], len(m.get("tool_calls", []))] for m in D.messages(x, [])]


def target(x: str):
    content, calls = D.answer(x, "target", [])
    return [content, [c["name"] for c in calls]]


def repaired(x: str):
    events: list = []
    return [D.repair(json.loads(x), events), [e[1] for e in events]]


S, E = D.START, D.STOP
CALL = '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>'
HEAD = "Be kind.\n\n" + D.HEADER

#: name: a rule from a text to a text, and cases of both.
CASES: dict[str, tuple[Callable, list[tuple[str, str]]]] = {
    "fn_split_instruction": (listed(lambda x: list(D.instruction_parts(x))), [
        (HEAD + "{}\n" + D.FOOTER, '["Be kind.",["{}"]]'), (HEAD + "a\r\nb\n" + D.FOOTER + ".", '["Be kind.",["a","b"]]'), (D.HEADER + D.FOOTER, '["",[]]'), ("Be kind.", "instruction/tool_block_header_not_recognized"),
        (HEAD + "{}\n", "instruction/tool_block_footer_not_recognized"), (HEAD + "{}" + D.FOOTER, "instruction/tool_block_not_line_delimited"), (HEAD + "{}\n\n" + D.FOOTER, "instruction/tool_block_blank_line"), (HEAD + HEAD + "{}\n" + D.FOOTER, "instruction/tool_block_header_not_recognized"),
    ]),
    "fn_split_roles": (listed(lambda x: [list(b) for b in D.role_blocks(x)]), [
        ("plain", '[["user","plain"]]'), (f"{S}user\nhi{E}\n{S}assistant\nyes{E}", '[["user","hi"],["assistant","yes"]]'), (f"first{E}\n{S}user\nopen", '[["user","first"],["user","open"]]'), (f"{S}system\nx{E}", "dialogue/unsupported_role"),
        (f"{S}user\na{S}user\nb", "dialogue/im_start_inside_open_message"), (f"{S}user\na{E}{E}", "dialogue/im_end_without_im_start"), (f"{S}user\na{E}text{S}user\nb", "dialogue/text_outside_role_block"), (f"{S}user", "dialogue/role_header_unterminated"),
    ]),
    "fn_tagged_segments": (listed(lambda x: [list(p) for p in D.tagged(x, "think", "target")]), [
        ("a<think>b</think>c", '[["a","c"],["b"]]'), ("none", '[["none"],[]]'), ("<think>a", "target/unbalanced_think_tags"), ("a</think>", "target/unbalanced_think_tags"), ("<think><think>a</think></think>", "target/unbalanced_think_tags"), ("<think></think><think>x</think>", '[["","",""],["","x"]]'),
    ]),
    "fn_strip_think": (listed(lambda x: D.answer(x, "target", [])[0]), [
        ("<think>why</think> yes ", "yes"), ("yes", "yes"), ("a <think>b</think> c", "a  c"), ("<think>a", "target/unbalanced_think_tags"), ("\r\nx\r\n", "x"),
    ]),
    "fn_parse_call": (listed(lambda x: D.call(x, "target")), [
        ('{"name": "f", "arguments": {"x": 1}}', '{"arguments":{"x":1},"name":"f"}'), ("{", "target/tool_call_invalid_json"), ('{"name": "f", "name": "g", "arguments": {}}', "target/tool_call_invalid_json"), ("[1]", "target/tool_call_not_object"),
        ('{"name": "f", "arguments": {}, "id": 1}', "target/tool_call_unexpected_keys"), ('{"name": " ", "arguments": {}}', "target/tool_call_name_missing_or_empty"), ('{"name": "f"}', "target/tool_call_arguments_missing"), ('{"name": "f", "arguments": "{}"}', "target/tool_call_arguments_not_object"), ('{"name": "f", "arguments": {"x": NaN}}', "target/tool_call_invalid_json"),
    ]),
    "fn_parse_target": (listed(target), [
        ("yes", '["yes",[]]'), ("so " + CALL, '["so",["f"]]'), (CALL + CALL, '["",["f","f"]]'), (CALL + " after", "target/assistant_text_after_tool_call"), ("<tool_call>", "target/unbalanced_tool_call_tags"), (f"a{E}", "target/residual_framing_token"), ("a<tool_response>b", "target/residual_control_tag"), ("<think>x</think>", '["",[]]'),
    ]),
    "fn_parse_dialogue": (listed(turns), [
        (f"{S}user\nhi{E}\n{S}assistant\nyes{E}\n{S}user\nmore{E}", '[["user","hi",0],["assistant","yes",0],["user","more",0]]'), (f"{S}user\nhi{E}{S}assistant\n{CALL}{E}{S}user\n<tool_response>1</tool_response>{E}", '[["user","hi",0],["assistant","",1],["tool","1",0]]'),
        (f"{S}user\nhi{E}{S}assistant\n{CALL}{E}", "dialogue/prompt_ends_with_unanswered_tool_calls"), (f"{S}user\nhi{E}{S}assistant\n{CALL}{E}{S}user\nno{E}", "dialogue/tool_call_without_tool_response"), (f"{S}assistant\nhi{E}{S}user\nx", "dialogue/dialogue_does_not_start_with_user"),
        (f"{S}user\nhi{E}{S}assistant\nyes{E}", "dialogue/prompt_ends_with_assistant"), (f"{S}user\n {E}", "dialogue/empty_user_message"), (f"{S}user\n<tool_response>1</tool_response>{E}", "dialogue/tool_response_without_tool_call"),
        (f"{S}user\na{E}{S}assistant\n{CALL}{E}{S}user\n<tool_response>1</tool_response><tool_response>2</tool_response>{E}", "dialogue/tool_response_count_mismatch"), (f"{S}user\na{E}{S}assistant\n{CALL}{E}{S}user\n<tool_response>1</tool_response>x{E}", "dialogue/tool_response_mixed_with_user_text"),
    ]),
    "fn_parse_tools": (listed(tool_lines), [
        ('{"name": "f", "description": "d", "parameters": {"type": "dict", "properties": {}}}', '[["f",{"properties":{},"type":"object"}],["schema_type_alias"]]'), ("{", "tools/tool_definition_invalid_json"), ("[]", "tools/tool_definition_not_object"), ('{"name": ""}', "tools/tool_name_missing_or_empty"),
        ('{"name": "f"}', "schema/tool_parameters_missing"), ('{"name": "f", "parameters": 1}', "schema/tool_parameters_not_object"), ('{"name": "f", "description": 1, "parameters": {}}', "tools/tool_description_not_string"), ('{"name": "f", "parameters": {"type": "text"}}', "schema/tool_schema_invalid_draft7"),
        ('{"name": "f", "parameters": {"type": "string"}}', "schema/tool_schema_root_not_object"), ('{"name": "f", "parameters": {"type": "object", "properties": {}, "required": ["x"]}}', "schema/tool_schema_required_properties_mismatch"),
    ]),
    "agg_tool_dedup": (listed(tool_lines), [
        ('{"name": "f", "description": "d", "parameters": {"type": "object"}}\n{"parameters": {"type": "object"}, "name": "f", "description": "d"}', '[["f",{"properties":{},"type":"object"}],["identical_duplicate_tool_definition_removed","schema_empty_object_properties_added"]]'),
        ('{"name": "f", "parameters": {"type": "object"}}\n{"name": "f", "parameters": {"type": "object", "title": "t"}}', "tools/conflicting_duplicate_tool_name"),
    ]),
    "fn_type_expr": (lambda x: "none" if D.type_schema(x) is None else canonical(list(D.type_schema(x))), [
        ("dict", '[{"type":"object"},false]'), ("string", '[{"type":"string"},false]'), ("List[int]", '[{"items":{"type":"integer"},"type":"array"},false]'), ("Tuple[str, float]", '[{"items":[{"type":"string"},{"type":"number"}],"maxItems":2,"minItems":2,"type":"array"},false]'),
        ("int, optional", '[{"type":"integer"},true]'), ("List[List[str]]", '[{"items":{"items":{"type":"string"},"type":"array"},"type":"array"},false]'), ("List[thing]", "none"), ("text", "none"), ("List[int", "none"), ("int, optional, optional", "none"),
    ]),
    "fn_repair_schema": (listed(repaired), [
        ('{"type": "dict", "properties": {"a": {"type": "float"}}}', '[{"properties":{"a":{"type":"number"}},"type":"object"},["schema_type_alias","schema_type_alias"]]'), ('{"type": "object"}', '[{"properties":{},"type":"object"},["schema_empty_object_properties_added"]]'),
        ('{"type": "object", "required": ["a"]}', '[{"required":["a"],"type":"object"},[]]'), ('{"type": "List[str]"}', '[{"items":{"type":"string"},"type":"array"},["schema_type_alias","schema_list_type_expanded"]]'), ('{"type": "int, optional"}', '[{"type":"integer"},["schema_type_alias","schema_optional_suffix_removed"]]'),
    ]),
    "fn_required_check": (lambda x: D.required_problem(json.loads(x)) or "-", [
        ('{"required": ["a"], "properties": {"a": {}}}', "-"), ('{"required": ["a", "a"], "properties": {"a": {}}}', "/: repeated"), ('{"required": ["b"], "properties": {"a": {}}}', "/: not declared"), ('{"required": ["b"], "properties": {}, "additionalProperties": {}}', "-"),
        ('{"properties": {"x": {"required": ["b"], "properties": {}}}}', "/properties/x: not declared"), ('{"required": ["b"], "properties": {}, "patternProperties": {}}', "-"),
    ]),
    "fn_schema_error": (lambda x: (structure.schema_errors(json.loads(x)) or ["-"])[0], [
        ('{"type": "object"}', "-"), ('{"type": "text"}', "$: type"), ('{"minLength": -1}', "$: minLength"), ('{"minimum": "1"}', "$: minimum"), ('{"multipleOf": 0}', "$: multipleOf"), ('{"pattern": "("}', "$: pattern"), ('{"enum": "a"}', "$: enum"), ('{"required": ["a", "a"]}', "$: required"), ('{"anyOf": []}', "$: anyOf"),
        ('{"properties": {"a": {"type": ["string", "string"]}}}', "$.a: type"), ('{"items": [{"type": 1}]}', "$[0]: type"), ('{"properties": []}', "$: properties"), ('{"additionalProperties": 1}', "$.additionalProperties: a schema is an object"), ("true", "-"), ('{"uniqueItems": 1}', "$: uniqueItems"), ('{"dependencies": {"a": ["b", "b"]}}', "$.dependencies.a: names"), ('{"not": {"maxItems": 1.5}}', "$.not: maxItems"),
    ]),
    "fn_parse_call_expr": (lambda x: "none" if D.parse_call_text(x) is None else canonical(list(D.parse_call_text(x))), [
        ("f(1, 'a', k=[1, 2])", '["f",[1,"a"],{"k":[1,2]}]'), ("a.b(x=None)", '["a.b",[],{"x":null}]'), ("f(g(1))", "none"), ("f", "none"), ("f(x)", "none"), ("f()", '["f",[],{}]'), ("f(1", "none"), ("f(-1.5, True)", '["f",[-1.5,true],{}]'),
    ]),
    "fn_bind_positional": (lambda x: canonical(D.bind_positional(*json.loads(x))), [
        ('[["a", "b"], [1], {"b": 2}]', '{"a":1,"b":2}'), ('[["a", "b"], [1, 2], {}]', '{"a":1,"b":2}'), ('[["a"], [1], {"a": 3}]', '{"a":3}'), ('[[], [], {}]', "{}"),
    ]),
    "fn_json_schema_map": (lambda x: canonical(tools.plain_schema(json.loads(x))), [
        ('{"type": "dict", "default": 1, "properties": {"a": {"type": "float", "default": 2}, "b": {"type": "list", "items": {"type": "tuple"}}}}', '{"properties":{"a":{"type":"number"},"b":{"items":{"type":"array"},"type":"array"}},"type":"object"}'), ('{"type": "any"}', '{"type":"any"}'), ('[{"type": "dict"}, 1]', '[{"type":"object"},1]'), ('{"enum": ["dict"]}', '{"enum":["dict"]}'),
    ]),
    "fn_coerce_args": (lambda x: canonical(tools.arguments(json.loads(x))), [
        ('{"arguments": {"a": 1}}', '{"a":1}'), ('{"arguments": "{\\"a\\": 1}"}', '{"a":1}'), ('{"arguments": "[1]"}', "{}"), ('{"arguments": "no"}', "{}"), ('{"arguments": 3}', "{}"), ("null", "{}"), ("{}", "{}"),
    ]),
    "fn_tool_signature": (lambda x: str(tools.signature(json.loads(x)) == tools.signature([{"name": "f", "parameters": {"type": "object", "properties": {}}}, {"name": "g"}])), [
        ('[{"name": "g"}, {"name": "f", "parameters": {"type": "dict"}}]', "True"), ('[{"name": "f", "parameters": {"type": "object"}, "description": "else"}, {"name": "g", "parameters": null}]', "True"), ('[{"name": "f"}, {"name": "g"}]', "False"), ("[]", "False"),
    ]),
    "proj_tool_schemas": (lambda x: canonical([[t["function"]["name"], t["function"]["description"], t["function"]["parameters"]] for t in tools.inventory(*json.loads(x))]), [
        ('[[{"name": "b", "description": "d", "parameters": {"type": "dict"}}, {"name": "a"}], []]', '[["a","",{"properties":{},"type":"object"}],["b","d",{"type":"object"}]]'), ('[[{"name": "b"}, {"name": "a"}], ["b"]]', '[["a","",{"properties":{},"type":"object"}]]'), ("[[], []]", "[]"), ('[[{"name": "a", "description": "1"}, {"name": "a", "description": "2"}], []]', '[["a","2",{"properties":{},"type":"object"}]]'),
    ]),
    "fn_ifbench_args": (lambda x: canonical([tools.instruction_ids(json.loads(x)[0]), tools.instruction_arguments(json.loads(x)[1], len(tools.instruction_ids(json.loads(x)[0])))]), [
        ('[["a", " b ", null, ""], [{"n": 1, "m": null}, 3]]', '[["a","b"],[{"n":1},{}]]'), ('[["a", "b"], {"n": 1}]', '[["a","b"],[{"n":1},{"n":1}]]'), ('[["a", "b", "c"], [{"n": 1}, {"n": 2}]]', '[["a","b","c"],[{"n":1},{"n":2},{"n":2}]]'), ('[["a"], [{"n": 1}, {"n": 2}]]', '[["a"],[{"n":1}]]'), ('[["a"], null]', '[["a"],[{}]]'), ("[[], []]", "[[],[]]"),
    ]),
    "fn_call_problems": (lambda x: reason(lambda: D.call(x, "history")["name"]), [
        ('{"name": "f", "arguments": {}}', "f"), ('{"arguments": {}}', "history/tool_call_name_missing_or_empty"), ("x", "history/tool_call_invalid_json"), ('{"name": "f", "arguments": []}', "history/tool_call_arguments_not_object"),
    ]),
    "filter_text_contract": (lambda x: reason(lambda: D.plain(x, "target", "text") and "clean"), [
        ("words", "clean"), (f"a {S}user", "target/residual_framing_token"), ("a <|endoftext|>", "target/residual_framing_token"), ("a </tool_call>", "target/residual_control_tag"), ("a <think>", "target/residual_control_tag"), ("a <b>", "clean"),
    ]),
    "rw_tool_trajectory": (lambda x: str(round(__import__("weftline.functions.rewards", fromlist=["x"]).trajectory_reward(*json.loads(x)), 4)), [
        ('[[{"name": "f"}], [{"name": "f"}], true, true]', "1.0"), ('[[], [{"name": "f"}], true, false]', "0.1"), ('[[], [], false, false]', "0.45"), ('[[{"name": "f"}, {"name": "g"}], [{"name": "g"}, {"name": "f"}], true, true]', "0.8"), ('[[{"name": "g"}], [{"name": "f"}, {"name": "g"}], false, false]', "0.125"),
    ]),
}


def dealt(values: list[str]):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(len(values))).cast("int"))


def query(rule: Callable, cases: list[tuple[str, str]]):
    @F.pandas_udf(StringType())
    def apply(x: pd.Series) -> pd.Series:
        return x.map(rule)

    return lambda s, d: table(s, d, "conversations").select("conv_id", "turn", apply(dealt([c[0] for c in cases])).alias("out"))


def sql(cases: list[tuple[str, str]]) -> str:
    values = ", ".join("'" + c[1].replace("'", "''") + "'" for c in cases)
    return f"SELECT conv_id, turn, ([{values}])[(conv_id * 31 + turn) % {len(cases)} + 1] AS out FROM conversations"


def dialogues(s, d):
    """Whole source rows: calls of tools that are there or not, with arguments that fit or not, answered or not."""
    defs = '{"name": "f", "description": "d", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}\n'
    call = lambda name, args: f'<tool_call>{{"name": "{name}", "arguments": {args}}}</tool_call>'
    told = lambda c: f"{S}user\nhi{E}{S}assistant\n{c}{E}{S}user\n<tool_response>1</tool_response>{E}"
    rows = [(told(call("f", '{"x": 1}')), "yes"), (told(call("g", "{}")), "yes"), (told(call("f", '{"x": "a"}')), "yes"), (f"{S}user\nhi{E}", call("f", '{"x": 2}')), (f"{S}user\nhi{E}", call("f", "{}")), (f"{S}user\nhi{E}", call("g", "{}"))]
    t = table(s, d, "conversations").select("conv_id", "turn", F.lit(D.HEADER + defs + D.FOOTER).alias("i"), dealt([r[0] for r in rows]).alias("d"), dealt([r[1] for r in rows]).alias("o"))
    r = t.select("conv_id", "turn", D.py_parse("i", "d", "o").alias("r"))
    warned = F.exists("r.events", lambda e: e["code"] == "history_arguments_do_not_match_schema")
    return r.select("conv_id", "turn", F.coalesce(F.concat_ws("/", "r.stage", "r.reason"), F.lit("")).alias("reason"), warned.alias("warned"))


INVENTORY = ["", "dialogue/tool_call_name_not_in_inventory", "", "", "target/target_arguments_do_not_match_schema", "target/tool_call_name_not_in_inventory"]


def pairing(s, d):
    """Calls by their number, each joined with the response that answers it."""
    two = f"{S}user\nhi{E}{S}assistant\n{CALL}{CALL}{E}{S}user\n<tool_response>1</tool_response><tool_response>2</tool_response>{E}"
    three = two + f"{S}assistant\n{CALL}{E}{S}user\n<tool_response>3</tool_response>{E}"

    @F.pandas_udf(StringType())
    def pairs(x: pd.Series) -> pd.Series:
        def one(text):
            m = D.messages(text, [])
            answers = {a["tool_call_id"]: a["content"] for a in m if a["role"] == "tool"}
            return ",".join(f"{c['id']}={answers[c['id']]}" for a in m for c in a.get("tool_calls", []))

        return x.map(one)

    return table(s, d, "conversations").select("conv_id", "turn", pairs(dealt([two, three])).alias("pairs"))


QUERIES = {**{n: query(*c) for n, c in CASES.items()}, "join_tool_inventory": dialogues, "join_call_response": pairing}
SQL = {
    **{n: sql(c[1]) for n, c in CASES.items()},
    "join_tool_inventory": f"SELECT conv_id, turn, ({INVENTORY})[(conv_id * 31 + turn) % 6 + 1] AS reason, (conv_id * 31 + turn) % 6 = 2 AS warned FROM conversations",
    "join_call_response": "SELECT conv_id, turn, (['call_0=1,call_1=2', 'call_0=1,call_1=2,call_2=3'])[(conv_id * 31 + turn) % 2 + 1] AS pairs FROM conversations",
}
