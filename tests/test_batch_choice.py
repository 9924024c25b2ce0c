import pytest
from pyspark.sql import functions as F

from trainprep.operators import batch, choice, scores


def test_pad_batch_keeps_last_columns(spark):
    df = spark.createDataFrame([(0, 0, 1, list(range(3)), [1, 2, -100]),
                                (0, 0, 2, list(range(100, 150)), list(range(50)))],
                               "rank int, batch long, id int, input_ids array<int>, labels array<int>")
    out = {r.id: r for r in batch.pad_batch(df, 10, 258).collect()}
    assert list(out[1].input_ids) == [258] * 10  # short row loses its tokens (default rule)
    assert list(out[2].input_ids) == list(range(140, 150))
    per = {r.id: r for r in batch.pad_batch(df, 10, 258, per_example=True).collect()}
    assert list(per[1].input_ids) == [0, 1, 2] + [258] * 7


def test_assign_examples_wraps(spark):
    df = spark.range(7).withColumnRenamed("id", "pos")
    out = batch.assign_examples(df, 7, 3).collect()
    assert len(out) == 9
    by_rank = {}
    for r in out:
        by_rank.setdefault(r["rank"], []).append(r.pos)
    assert sorted(by_rank[0]) == [0, 0, 3, 6][:0] + sorted([0, 3, 6])
    assert sorted(by_rank[1]) == [0, 1, 4]


def test_blank_choice_errors(spark):
    df = spark.createDataFrame([("no blank", "a", "b", "1")], "sentence string, option1 string, option2 string, answer string")
    with pytest.raises(Exception):
        choice.prepare_blank_choice(df).collect()
    df2 = spark.createDataFrame([("a _ b _", "x", "y", "1")], "sentence string, option1 string, option2 string, answer string")
    assert choice.prepare_blank_choice(df2, on_error="drop").count() == 0


def test_score_ties_and_zero_mask(spark):
    rows = [(1, 0, 1, 1, 2.0), (1, 1, 1, 1, 2.0),     # tie -> lowest index
            (2, 0, 1, 1, 0.5), (2, 1, 1, 0, 9.0)]     # all-zero mask -> mean 0 wins
    df = spark.createDataFrame(rows, "item_id int, choice int, pos int, mask int, loss double")
    got = {r.item_id: r.pred for r in choice.score_choices(df).collect()}
    assert got == {1: 0, 2: 1}


def test_ngram_bans_match_loop(spark):
    seqs = [[1, 2, 3, 1, 2, 4, 1, 2], [5, 5, 5], [1], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, t array<int>")
    got = {r.i: sorted(r.b) for r in df.select("i", scores.ngram_bans(F.col("t"), 3).alias("b")).collect()}

    def loop(t, n):
        if len(t) < n - 1:
            return []
        banned = {}
        for i in range(len(t) - n + 1):
            banned.setdefault(tuple(t[i:i + n - 1]), set()).add(t[i + n - 1])
        return sorted(banned.get(tuple(t[-(n - 1):]), ()))

    assert got == {i: loop(s, 3) for i, s in enumerate(seqs)}


def test_truncate_at_stop(spark):
    df = spark.createDataFrame([([9, 9, 1, 2, 265, 3, 257], 2), ([9, 1, 2, 3], 1)], "t array<int>, p int")
    got = [list(r.g) for r in df.select(scores.truncate_at_stop(F.col("t"), F.col("p"), [257, 265], 5).alias("g")).collect()]
    assert got == [[1, 2], [1, 2, 3]]


def test_shard_items_pad_and_empty_ending(spark):
    df = spark.createDataFrame([(1, "ab", ["c", ""], 0), (2, "x", ["yz", "w"], 1), (3, "q", ["r", "s"], 0)],
                               "item_id long, ctx string, endings array<string>, label int")
    it = choice.prepare_completion_choice(df)
    first = it.where("item_id = 1").first()
    assert [list(r) for r in first.mask] == [[0, 0, 1], [0, 0, 0]]  # empty ending: no mask ones
    out = choice.shard_items(it, 2, pad=True).collect()
    per = {}
    for r in out:
        per.setdefault(r.worker, []).append(r.valid)
    assert sorted(len(v) for v in per.values()) == [2, 2]
    assert sum(not v for vs in per.values() for v in vs) == 1


def test_pad_preference_batch(spark):
    df = spark.createDataFrame([(0, 0, [1, 2], [3], [4, 5, 6]), (0, 0, [7], [8, 9], [10])],
                               "rank int, batch long, prompt_input_ids array<int>, chosen_input_ids array<int>, rejected_input_ids array<int>")
    rows = batch.pad_preference_batch(df, 10, 258).orderBy(F.col("prompt_input_ids")[0]).collect()
    assert [list(r.prompt_input_ids) for r in rows] == [[1, 2], [7, 258]]
    assert [list(r.chosen_input_ids) for r in rows] == [[3, 258], [8, 9]]
    assert [list(r.rejected_input_ids) for r in rows] == [[4, 5, 6], [10, 258, 258]]
