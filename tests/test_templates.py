"""Chat / preference / prompt templates against a plain re-statement in Python,
on real rows of the sf0.001 tables."""

from trainprep.operators import normalize as nz, tokenize
from trainprep.plans.q_chat import pairs, sft
from trainprep.operators.tokenizers import get_tokenizer

SF = "/root/testdata/sf0.001"
SYS = "You are a helpful AI assistant"


def _head(tok):
    return [tok.bos_id, tok.sh_id] + tok.encode("system") + [tok.eh_id] + tok.encode("\n" + SYS) + [tok.eot_id]


def _chat(tok, conv):
    ids, labels = [], []

    def push(t, keep):
        ids.extend(t)
        labels.extend(t if keep else [-100] * len(t))

    push(_head(tok), False)
    for role, content in conv:
        push([tok.sh_id] + tok.encode(role) + [tok.eh_id] + tok.encode("\n"), False)
        push(tok.encode(content) + [tok.eot_id], role == "assistant")
    return ids, labels[1:] + [-100]


def test_encode_chat_equals_plain_template(spark):
    tok = get_tokenizer("bytes")
    rows = tokenize.encode_chat(sft(spark, SF)).collect()
    assert rows
    for r in rows:
        conv = [(t.role, t.content) for t in r.conversation]
        ids, labels = _chat(tok, conv)
        assert list(r.input_ids) == ids
        assert list(r.labels) == labels


def test_encode_preference_equals_plain_template(spark):
    tok = get_tokenizer("bytes")
    rows = tokenize.encode_preference(nz.normalize_dpo(pairs(spark, SF))).collect()
    assert rows
    answer = [tok.sh_id] + tok.encode("assistant") + [tok.eh_id] + tok.encode("\n")
    for r in rows:
        prompt = list(_head(tok))
        for t in r.prompt:
            prompt += [tok.sh_id] + tok.encode(t.role) + [tok.eh_id] + tok.encode("\n") + tok.encode(t.content) + [tok.eot_id]
        assert list(r.prompt_input_ids) == prompt
        assert list(r.chosen_input_ids) == answer + tok.encode(r.chosen) + [tok.eot_id]
        assert list(r.rejected_input_ids) == answer + tok.encode(r.rejected) + [tok.eot_id]


def test_null_content_is_an_empty_turn(spark):
    from trainprep.operators import tokenize

    kind = "conv_id long, conversation array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("user", None), ("assistant", "x")]), (2, [("user", ""), ("assistant", "x")]), (3, None)], kind)
    rows = {r.conv_id: r for r in tokenize.encode_chat(df).collect()}
    assert rows[1].input_ids == rows[2].input_ids and rows[1].labels == rows[2].labels
    assert rows[3].input_ids is not None and set(rows[3].labels) == {-100}


def test_pretokens_by_hand(spark):
    from trainprep.operators import tokenize

    cases = {
        "Hello world's 12345 tests!!\n\n  ok": ["Hello", " world", "'s", " ", "123", "45", " tests", "!!\n\n", " ", " ok"],
        "a  b": ["a", " ", " b"],
        "x\ty  ": ["x", "\ty", "  "],
        "don't DON'T": ["don", "'t", " DON", "'T"],
        "\u00e9t\u00e9 \u4f60\u597d": ["\u00e9t\u00e9", " \u4f60\u597d"],
        " \n \nz": [" \n \n", "z"],
        "(a)": ["(a", ")"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", tokenize.pretokenize("t").alias("p")).collect():
        assert r.p == cases[r.t], (r.t, r.p)
