import pytest
from pyspark.sql import functions as F

from trainprep.operators import normalize as nz, tokenize

CONV = "array<struct<role:string,content:string>>"


def test_byte_round_trip_and_nulls(spark):
    texts = ["", "abc", "héllo\nwörld ✓", None, "𝄞 clef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    d = df.withColumn("ids", tokenize.encode_col("text"))
    d = tokenize.decode_corpus(d.drop("text"), "ids", "back").orderBy("i").collect()
    for r, t in zip(d, texts):
        assert r.back == t
        if t is not None:
            assert list(r.ids) == list(t.encode("utf-8"))


def test_decode_renders_specials(spark):
    df = spark.createDataFrame([([104, 105, 257, 106],)], "ids array<int>")
    assert tokenize.decode_corpus(df).first().text == "hi<|end_of_text|>j"


def test_encode_chat_labels(spark):
    conv = [("system", "be nice"), ("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame([(1, [{"role": r, "content": c} for r, c in conv])], f"conv_id int, conversation {CONV}")
    r = tokenize.encode_chat(df).first()
    ids, labels = list(r.input_ids), list(r.labels)
    assert len(ids) == len(labels) == 41 + sum(4 + len(a) + len(b) for a, b in conv)
    assert labels[-1] == -100
    assert all(labels[i] in (-100, ids[i + 1]) for i in range(len(ids) - 1))
    assert [l for l in labels if l != -100] == list(b"yo") + [265]


def test_normalize_sft_cases(spark):
    rows = [
        (1, [("system", "s"), ("assistant", "a")]),          # system first -> empty user before it
        (2, [("user", "u"), ("assistant", " ")]),       # NBSP only -> dropped
        (3, [("user", str(i)) if i % 2 == 0 else ("assistant", str(i)) for i in range(12)]),  # > 8 turns
    ]
    df = spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in t]) for i, t in rows],
                               f"conv_id int, conversation {CONV}")
    out = {r.conv_id: r.conversation for r in nz.normalize_sft(df).collect()}
    assert set(out) == {1, 3}
    assert [t.role for t in out[1]] == ["user", "system", "assistant"]
    assert out[1][0].content == ""
    assert len(out[3]) == 8


def test_placeholders_word_boundary(spark):
    conv = [{"role": "user", "content": "NAME_1 met NAME_10 and NAME_1"}, {"role": "assistant", "content": "hi NAME_10"}]
    df = spark.createDataFrame([(1, conv)], f"conv_id int, conversation {CONV}")
    r = df.select(nz.replace_placeholders("conversation", ["Ann", "Bob"], 42, key=F.col("conv_id")).alias("c")).first().c
    a, b = r[0].content.split(" met ")
    first, rest = a, b.split(" and ")
    assert first == rest[1] and first in ("Ann", "Bob")
    assert rest[0] in ("Ann", "Bob") and rest[0] != first
    assert r[1].content == "hi " + rest[0]
    with pytest.raises(ValueError):
        nz.replace_placeholders("conversation", [], 42)


def test_parse_transcript_cases(spark):
    cases = {
        "\n\nHuman: hi\n\nAssistant: yo\n": [("user", "hi"), ("assistant", "yo\n")],
        "\n\nHuman: a\nAssistant: b": [("user", "a\nAssistant: b")],
        "no markers": [],
        "lead\n\nHuman: q": [("user", "q")],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: [(x.role, x.content) for x in r.c] for r in df.select("t", nz.parse_transcript("t").alias("c")).collect()}
    assert got == cases


def test_preference_triple_edges(spark):
    df = spark.createDataFrame([("\n\nHuman: only", "\n\nHuman: only"),
                                ("\n\nHuman: q\n\nAssistant: good", "\n\nHuman: q\n\nAssistant: bad")],
                               "chosen string, rejected string")
    rows = nz.preference_triple(df).collect()
    assert rows[0].chosen == "" and rows[0].prompt == []
    assert rows[1].chosen == "good" and rows[1].rejected == "bad"
    assert nz.normalize_dpo(df).count() == 1


def test_pretokenize_lossless(spark):
    df = spark.createDataFrame([("It's 12345 tests!\n\n  ok",)], "t string")
    toks = df.select(tokenize.pretokenize("t").alias("p")).first().p
    assert "".join(toks) == "It's 12345 tests!\n\n  ok"
    assert "123" in toks and "45" in toks


def test_adapt_messages_sparse_turn_numbers(spark):
    rows = [(1, 10, "user", "a"), (1, 20, "assistant", "b"), (1, 35, "user", "c"), (1, 90, "assistant", "d"),
            (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: [t.content for t in r.conversation]
           for r in nz.adapt_messages(df, max_turns=3).collect()}
    assert out == {1: ["a", "b", "c"], 2: ["x"]}


def test_turn_limit_keeps_the_first_turns_wherever_they_start(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(1, 11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = nz.adapt_messages(df, max_turns=8).first()
    assert [t.content for t in got.conversation] == [f"t{t}" for t in range(1, 9)]


def test_turn_limit_is_applied_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, t, "user", "x") for t in range(10)], "conv_id long, turn long, role string, text string")
    plan = nz.adapt_messages(df, max_turns=3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.index("Exchange")


@pytest.mark.parametrize("n", [0, 1, 7, 8, 11, 14, 15, 500])
def test_take_first_is_one_operator_for_any_size(spark, n):
    """Ties, NULL keys (last) and whole repeated rows; exactly n rows where there are n."""
    rows = [("b", 1), ("a", 2), ("a", 3), ("a", 3), (None, 4), (None, 4), (None, 5), ("c", 6), ("c", 7), ("c", 7), ("c", 7), ("d", 8), ("e", 9), ("é", 1)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    got = [r.k for r in nz.take_first(df, n, "k").collect()]
    order = sorted((k for k, _ in rows), key=lambda k: (k is None, (k or "").encode()))
    assert sorted(got, key=str) == sorted(order[:n], key=str)
    ints = df.selectExpr("ascii(k) AS k", "v")
    assert nz.take_first(ints, n, "k").count() == min(n, len(rows))
    if n > len(rows):
        with pytest.raises(ValueError):
            nz.take_first(df, n, "k", strict=True)


def test_take_first_of_many_rows(spark):
    df = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)], "k long, v string")
    for n in (1, 123, 999, 1000):
        assert sorted(r.k for r in nz.take_first(df, n, "k").collect()) == list(range(n))


def test_replacement_names_are_literal(spark):
    df = spark.createDataFrame([(1, [("user", "I am NAME_1, not NAME_10"), ("assistant", "hi NAME_1")])],
                               "conv_id long, conversation array<struct<role:string,content:string>>")
    for name in ("$1", "a\\b", "x$", "$", "\\"):
        c = df.select(nz.replace_placeholders("conversation", [name], 1, key=F.col("conv_id")).alias("c")).first().c
        assert [t.content for t in c] == [f"I am {name}, not {name}", f"hi {name}"]


def test_prompt_mismatch_report(spark):
    df = spark.createDataFrame([("\n\nHuman: q\n\nAssistant: a", "\n\nHuman: q\n\nAssistant: b"),
                                ("\n\nHuman: q\n\nAssistant: a", "\n\nHuman: other\n\nAssistant: b")],
                               "chosen string, rejected string")
    assert [r.m for r in df.select(nz.prompt_mismatch().alias("m")).collect()] == [False, True]


def test_encoding_takes_a_batch_in_pieces(spark):
    import pyarrow as pa

    from trainprep.operators.tokenizers import get_tokenizer

    texts = ["a" * 400_000, None, "", "b" * 3_000_000, "c", "d" * 700_000, "é" * 300_000, None] * 2
    sizes = []

    def turn(arr):
        sizes.append(sum(len(t.encode()) for t in arr.to_pylist() if t))
        return get_tokenizer("bytes").encode_arrow(arr)

    batch = pa.array(["x", *texts]).slice(1)
    out = [ids for part in tokenize.by_pieces(turn, iter([batch, batch.slice(0, 0)])) for ids in part.to_pylist()]
    assert out == [None if t is None else list(t.encode()) for t in texts]
    assert len(sizes) > 4 and all(n <= tokenize.PIECE or n == 3_000_000 for n in sizes)
    lists = pa.array([["a" * 900_000, "b"], None, [], ["c" * 900_000, None]])
    assert [len(p) for p in tokenize.row_pieces(lists)] == [3, 1]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    d = df.withColumn("ids", tokenize.encode_col("text")).withColumn("back", tokenize.decode_col("ids"))
    many = tokenize.encode_many_col(F.array("text", F.lit("zz")))
    for r in d.withColumn("many", many).select("text", F.size("ids").alias("n"), "back", "many").collect():
        assert r.back == r.text and (r.text is None or r.n == len(r.text.encode()))
        assert r.many[1] == [122, 122] and (r.many[0] is None) == (r.text is None)
