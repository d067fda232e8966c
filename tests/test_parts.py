"""Parts that have no SQL: files and sealed shards, packing rules, JSON, rewards, cursor, greedy duplicates."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import answers, arrays, rewards, structure, text
from weftline.operators import batches, dedup, metrics, select
from weftline.plans.common import keeper, shared_folder
from weftline.sources import files, sealed
from weftline.streaming import rollout


def test_slices_of_paths():
    assert files.split_path("a/b.parquet@[-3:]") == ("a/b.parquet", -3, None)
    assert files.split_path("a/b.parquet") == ("a/b.parquet", None, None)
    assert select.bounds(-3, None, 10) == (7, 10) and select.bounds(2, 50, 10) == (2, 10)


def test_files(spark):
    path = shared_folder(spark, "files")
    for k, name in enumerate(("b", "a")):
        spark.range(k * 10, k * 10 + 5).repartition(1).write.parquet(f"{path}/{name}")
    rows = files.read_rows(spark, f"{path}@[3:7]")
    assert [r.id for r in rows.orderBy("ord").collect()] == [13, 14, 0, 1]  # folder a comes first
    with pytest.raises(FileNotFoundError):
        files.read_rows(spark, path + "-none")
    sealed.write_text(spark, f"{path}-j/x.json", '[{"a": 1}, {"a": 2}]')
    sealed.write_text(spark, f"{path}-j/y.json", '{"a": 3}\n{"a": 4}\n')
    sealed.write_text(spark, f"{path}-j/z.json", "neither")
    assert sorted(r[0] for r in files.read_json_documents(spark, f"{path}-j").select(F.variant_get("value", "$.a", "int")).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        files.read_rows(spark, f"{path}-j")


def test_sealed(spark):
    path = shared_folder(spark, "sealed")
    rows = spark.range(100).withColumn("g", F.col("id") % 7)
    m = sealed.seal(rows, spark, path, group="g", shards=3)
    assert m["rows"] == 100 and sealed.unseal(spark, path).count() == 100
    with pytest.raises(FileExistsError):
        sealed.seal(rows, spark, path)
    sealed.write_text(spark, f"{path}/manifest.json", sealed.canonical(m | {"rows": 99}))
    with pytest.raises(ValueError):
        sealed.unseal(spark, path)
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.digests(spark, f"{path}/data").collect()}
    assert files.read_locked(spark, f"{path}/data", got, "id", list(range(50)), F.col("id") < 50).count() == 50
    with pytest.raises(ValueError):
        files.read_locked(spark, f"{path}/data", {next(iter(got)): "0"}, "id", [], F.lit(True))


def test_packing_rules():
    rng = random.Random(0)
    for _ in range(40):
        n, k = rng.randint(4, 9), rng.randint(1, 4)
        sizes = [rng.randint(1, 50) for _ in range(n)]
        for parts in (batches.largest_differencing(sizes, k), batches.least_loaded(sizes, k)):
            assert sorted(itertools.chain(*parts)) == list(range(n)) and len(parts) == k
        assert all(batches.largest_differencing(sizes, k))
        sizes = sizes[: n // k * k]
        assert {len(p) for p in batches.largest_differencing(sizes, k, equal=True)} == {len(sizes) // k}
        assert all(sum(sizes[i] for i in b) <= 50 for b in batches.first_fit(sizes, 50))
        chunks = batches.size_chunks(sizes, 60)
        assert list(itertools.chain(*chunks)) == list(range(len(sizes))) and all(sum(sizes[i] for i in c) >= 60 for c in chunks[:-1])
    assert batches.largest_differencing([8, 7, 6, 5, 4], 2) == [[0, 3], [1, 2, 4]] or max(sum([8, 7, 6, 5, 4][i] for i in p) for p in batches.largest_differencing([8, 7, 6, 5, 4], 2)) <= 16


def test_json():
    assert structure.canonical(structure.strict('{"b": 1, "a": [true, null]}')) == '{"a":[true,null],"b":1}'
    for bad in ('{"a": 1, "a": 2}', "NaN", "[Infinity]", "{"):
        with pytest.raises(ValueError):
            structure.strict(bad)
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "t": {"type": "array", "items": {"enum": ["a", "b"]}}}, "required": ["n"], "additionalProperties": False}
    assert structure.errors({"n": 2, "t": ["a"]}, schema) == []
    assert structure.errors({"t": ["c"], "x": 1}, schema) == ["$.n: required", "$.t[0]: enum", "$.x: unknown"]
    assert structure.errors({"n": True}, schema) == ["$.n: type"] and structure.schema_errors({"type": "text", "required": ["a", "a"]}) == ["$: required", "$: type"]


def test_rewards():
    assert rewards.last_boxed(r"\boxed{1} and \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and rewards.last_boxed(r"\boxed{1") is None
    pairs = ((r"\frac{1}{2}", "0.5", True), ("1,000", "1000", True), (r"\text{yes}", "yes", True), ("(1, 2)", "(1,2)", True), ("(1, 2]", "(1,2)", False), ("0.333", "1/3", False), ("1/0", "2/0", False), ("50\\%", "50", True))
    for a, b, ok in (*pairs, (r"\sqrt2", r"\sqrt{2}", True), ("x=5", "5", True), (r"5\text{ cm}", "5", True), ("x+1", "1+x", True), ("x(x+1)", "x^2+x", True), ("x+y+z", "z+y+x", False), ("2/4", "1/2", False), ("3!", "6", False), ("n!", "n", False)):
        assert answers.right(a, b) is ok, (a, b)
    assert rewards.thought_reward(r"</think> so \boxed{7}", "7") == 1 and rewards.thought_reward(r"\boxed{7}", "7") == 0
    assert rewards.signed_reward("Answer: 3\nAnswer: 4", "4") == {"score": 1.0, "acc": True, "pred": "4"}
    assert rewards.signed_reward(r"\boxed{4}", "4", strict_box=True)["acc"] and not rewards.signed_reward("4", "4", strict_box=True)["acc"]
    with pytest.raises(ValueError):
        rewards.signed_reward("Answer: 3", "three")
    assert rewards.f1_reward("the cat sat", "a cat")["f1"] == pytest.approx(2 / 3) and rewards.f1_reward("yes it is", "yes")["f1"] == 0
    assert rewards.f1_reward("snake_case", "snakecase")["f1"] == 1 and rewards.f1_reward("l’un", "lun")["f1"] == 0  # ASCII punctuation alone goes
    assert rewards.choice_reward("D", 3) == 1 and rewards.choice_reward(None, "A") == 0
    with pytest.raises(ValueError):
        rewards.by_type("unheard of", "x", "y")
    c = [{"name": "f", "arguments": {"x": 1}}]
    assert rewards.trajectory_reward(c, c, True, True) == pytest.approx(1) and rewards.trajectory_reward([], c, True, False) == pytest.approx(0.1)


def test_array_functions(spark):
    row = spark.range(1).select(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]).alias("x"))
    one = lambda c: row.select(c).first()[0]
    assert one(arrays.discounted_returns(F.col("x"), 0.5)) == [3.25, 4.5, 5.0, 4.0]
    adv, ret = arrays.gae(F.col("x"), F.transform("x", lambda v: v * 0), 1.0, 1.0)
    assert one(adv) == [10.0, 9.0, 7.0, 4.0] and one(ret) == [10.0, 9.0, 7.0, 4.0]
    assert one(arrays.pass_at_k(F.lit(4), F.lit(0), F.lit(4))) == 0 and one(arrays.pass_at_k(F.lit(4), F.lit(2), F.lit(2))) == pytest.approx(5 / 6)
    assert [one(arrays.pass_hat_k(F.lit(4).cast("long"), F.lit(c).cast("long"), F.lit(2).cast("long"))) for c in (1, 2, 4)] == pytest.approx([0, 1 / 6, 1])
    with pytest.raises(Exception, match="holds nowhere"):
        one(arrays.add_at_last(F.col("x"), F.lit(1.0), F.transform("x", lambda v: F.lit(0))))


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d e f",), ("a b",), ("",), (None,)], "t string")
    got = df.select(F.size(text.shingles(text.norm_tokens(F.col("t")), 5)).alias("w"), F.size(text.shingles(text.norm_tokens(F.col("t")), 5, "none")).alias("n")).collect()
    assert [(r.w, r.n) for r in got] == [(2, 2), (1, 0), (0, 0), (0, 0)]


def test_greedy_duplicates_against_a_scan(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(80)}
    near = {x: set() for x in range(60)}
    for a, b in pairs:
        near[b].add(a)
    kept, want = set(), {}
    for x in range(60):
        hit = near[x] & kept
        if hit:
            want[x] = min(hit)
        else:
            kept.add(x)
    rows = [(a, b, False) for a, b in sorted(pairs)] + [(x, 1000 + x, True) for x in (0, 7, 59)]
    want |= {1000 + x: want.get(x, x) for x in (0, 7, 59)}  # copies of rows
    got = dedup.greedy_representatives(spark.createDataFrame(rows, "a long, b long, same boolean"), spark, keeper(spark, "greedy"))
    assert {r.removed: r.representative for r in got.collect()} == want


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(60):
        words = [f"w{i % 12}x{j}" for j in range(rng.randint(3, 40))]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"new{i}"
        texts[i] = " ".join(words)
    texts |= {100 + i: texts[5] + " tail" for i in range(9)} | {200: "", 201: None, 202: "a b"}
    rows = [(i, x, rng.choice(["en", "de", None])) for i, x in texts.items()]
    got = {(r.a, r.b): (round(r.jaccard, 9), r.same) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, text string, lang string"), "id", "text", "lang", 5, 0.6).collect()}
    sets = {i: (lang, frozenset(zip(*((x or "").split()[k:] for k in range(5))))) for i, x, lang in rows}
    first = {}
    for i in sorted(sets):
        if sets[i][1]:
            first.setdefault(sets[i], i)
    want = {(first[v], i): (1.0, True) for i, v in sets.items() if v[1] and first[v] != i}
    reps = sorted(first.values())
    for a in reps:
        for b in reps:
            if a < b and sets[a][0] == sets[b][0]:
                x, y = sets[a][1], sets[b][1]
                if len(x & y) / len(x | y) >= 0.6:
                    want[a, b] = (round(len(x & y) / len(x | y), 9), False)
    assert got == want and any(not same for _, same in want.values())


def test_ten_thousand_copies_give_linear_output(spark):
    copies = spark.range(10_000).select("id", F.lit("one two three four five six seven").alias("text"), F.lit("en").alias("lang"))
    got = dedup.near_pairs(copies, "id", "text", "lang", 5, 0.8)
    assert got.count() == 9999 and got.where("same and a = 0").count() == 9999


def test_ordinals_of_a_table_beyond_the_range_sample(spark):
    """Bounds that are sampled anew at every use give wrong places; one column, and several with ties."""
    rows = spark.range(1_000_000).select(F.xxhash64("id").alias("h"), (F.xxhash64("id") % 1000).alias("k"), "id")
    for order in (["h"], ["k", "h"]):
        o = select.ordinals(rows, order)
        n, lo, hi, k = o.agg(F.count("*"), F.min("ord"), F.max("ord"), F.countDistinct("ord")).first()
        assert (n, lo, hi, k) == (1_000_000, 0, 999_999, 1_000_000)
        before = o.join(o.select((F.col("ord") + 1).alias("ord"), *[F.col(c).alias(c + "_b") for c in order]), "ord")
        assert before.where(F.struct(*order) < F.struct(*[F.col(c + "_b") for c in order])).count() == 0
    assert select.ordinals(rows.limit(0), ["h"]).count() == 0


def test_cursor():
    c = rollout.EpochCursor(10, seed=3)
    first = c.take(10)
    assert sorted(first) == list(range(10)) and c.take(4) != first[:4] and c.epoch == 1
    d = rollout.EpochCursor.load(c.save())
    assert c.take(8) == d.take(8)
    with pytest.raises(ValueError):
        c.take(100)


def test_interval_and_limit():
    mean, low, high = metrics.bootstrap_interval([0.0, 1.0, 2.0], 500, seed=1)
    assert mean == 1 and 0 <= low <= 1 <= high <= 2 and metrics.bootstrap_interval([0.0, 1.0, 2.0], 500, seed=1) == (mean, low, high)
    assert select.choose_limit([(2048, False), (4096, True), (8192, True)]) == 4096 and select.choose_limit([(1, False), (2, False)]) == 2 and select.choose_limit([(1, True)], 7) == 7


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "item_id", "shared", "jaccard", "overlap"]


def tool_row(**k):
    from weftline.functions import dialogue as D

    tool = {"name": "get_weather", "description": "d", "parameters": {"type": "dict", "properties": {"city": {"type": "str"}, "days": {"type": "int, optional"}, "xs": {"type": "List[float]"}}, "required": ["city"]}}
    lines = k.get("lines", [structure.canonical(tool), structure.canonical(tool)])
    instruction = "Policy.\n\n" + D.HEADER + "".join(x + "\n" for x in lines) + D.FOOTER + "."
    call = '<tool_call>\n{"name": "get_weather", "arguments": {"city": "x"}}\n</tool_call>'
    text = f"hi<|im_end|>\n<|im_start|>assistant\n<think>a</think>ok {call}\n{call}<|im_end|>\n<|im_start|>user\n<tool_response>1</tool_response><tool_response>2</tool_response><|im_end|>\n<|im_start|>assistant\ndone<|im_end|>\n<|im_start|>user\nmore"
    return D, k.get("instruction", instruction), k.get("input", text), k.get("output", call)


def test_dialogue_parser():
    D, *row = tool_row()
    got = D.example(*row)
    assert got["status"] == "ok", got
    value = structure.strict(got["row"])
    assert [m["role"] for m in value["messages"]] == ["system", "user", "assistant", "tool", "tool", "assistant", "user"]
    assert [m.get("tool_call_id") for m in value["messages"] if m["role"] == "tool"] == ["call_0", "call_1"]
    assert value["tools"][0]["function"]["parameters"]["properties"] == {"city": {"type": "string"}, "days": {"type": "integer"}, "xs": {"type": "array", "items": {"type": "number"}}}
    codes = [e["code"] for e in got["events"]]
    assert codes.count("identical_duplicate_tool_definition_removed") == 1 and "schema_optional_suffix_removed" in codes and "schema_list_type_expanded" in codes
    for change, reason in (
        ({"instruction": "no tools"}, "tool_block_header_not_recognized"), ({"lines": ["{"]}, "tool_definition_invalid_json"), ({"lines": ['{"name": "f", "parameters": {"type": "object", "required": ["a"], "properties": {}}}']}, "tool_schema_required_properties_mismatch"),
        ({"lines": ['{"name": "f", "parameters": {"type": "object"}}', '{"name": "f", "parameters": {}}']}, "conflicting_duplicate_tool_name"), ({"input": "<|im_start|>system\nx<|im_end|>"}, "unsupported_role"),
        ({"input": "<|im_start|>user\nx<|im_start|>"}, "im_start_inside_open_message"), ({"input": "x<|im_end|>y"}, "text_outside_role_block"), ({"input": "a<|im_end|><|im_end|>"}, "im_end_without_im_start"), ({"input": "x<|im_end|><|im_start|>assistant\ny"}, "prompt_ends_with_assistant"),
        ({"input": "<tool_response>1</tool_response>"}, "tool_response_without_tool_call"), ({"input": ""}, "empty_user_message"), ({"output": ""}, "empty_target"), ({"output": "<tool_call>{</tool_call>"}, "tool_call_invalid_json"),
        ({"output": '<tool_call>{"name": "g", "arguments": {}}</tool_call>'}, "tool_call_name_not_in_inventory"), ({"output": '<tool_call>{"name": "get_weather", "arguments": {}}</tool_call>'}, "target_arguments_do_not_match_schema"),
        ({"output": "</tool_call>"}, "unbalanced_tool_call_tags"), ({"output": "a<|endoftext|>"}, "residual_framing_token"), ({"output": None}, "empty_target"),
    ):
        D, *row = tool_row(**change)
        got = D.example(*row)
        assert (got["status"], got["reason"]) == ("rejected", reason), (change, got)
    assert D.type_schema("Tuple[int, List[str]]")[0]["maxItems"] == 2 and D.type_schema("List[int, str]") is None and D.type_schema("Tuple[int") is None
    assert D.target_key({"content": "", "tool_calls": [{"function": {"a": 1}}, {"function": {"b": 2}}]}) == D.target_key({"content": "", "tool_calls": [{"function": {"b": 2}}, {"function": {"a": 1}}]})
    assert D.parse_call_text("m.f(1, k='x')") == ("m.f", [1], {"k": "x"}) and D.parse_call_text("f(g())") is None and D.bind_positional(["a", "b"], [1, 2], {"b": 3}) == {"a": 1, "b": 3}
