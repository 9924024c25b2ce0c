import math
import re

import numpy as np
import pytest
from corpus_fixtures import SF, empty_documents
from pyspark.sql import functions as F

from trainprep.llm import urls as U
from trainprep.llm.queries import URL_RULES


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    tail = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def longest_rule(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/EN/x", "http://a.example.net/en/y", "http://example.net/en",
            "http://notexample.net/en/", "http://net", "http://net/", "http://x.net?q", "a://b://c/d", "http://ÀB.org/fr/é?x#y",
            "http://example.com/de/", "http://example.com/de", "//x.net/", "http://h#f/x", "http://u@h:80/p", "http://x.org/fr/../",
            "http://" + "a" * 30_000 + ".com/" + "b" * 30_000, "http://x.com/\n/y"]


def test_parse_and_rules_equal_the_contract(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(ODD_URLS)], "page_id long, url string, html string")
    pages = pages.union(spark.read.parquet(f"{SF}/pages.parquet"))
    found = U.judge_urls(pages, URL_RULES).collect()
    assert len(found) == pages.count()
    for r in found:
        host, path = parsed(r["url"])
        rule, verdict = longest_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == (verdict or ("block" if r["odds"] > 0 else "allow"))
        assert "".join(r["host_words"]) == "".join(
            "0" if t.isdigit() else t for t in re.findall("[a-z]+|[0-9]+", host))


def all_splits(name):
    if not name:
        yield []
    for i in range(1, len(name) + 1):
        for rest in all_splits(name[i:]):
            yield [name[:i], *rest]


def test_viterbi_equals_trying_every_split():
    logs = {w: math.log(p) for w, p in {"the": .05, "there": .01, "here": .02, "rain": .01, "train": .005, "in": .03, "a": .04, "ther": .0001}.items()}
    cut = U.Segmenter(logs, 1e6)
    for name in ["therain", "thetrain", "therein", "xtherex", "arain", "a", "qqq", "inthere"]:
        score = lambda ws: sum(logs.get(w, cut.unknown(len(w))) for w in ws)
        assert score(cut.split(name)) == pytest.approx(max(map(score, all_splits(name))))
    assert cut.split("therain") == ["the", "rain"]
    assert "".join(cut.split("z" * 20_000)) == "z" * 20_000


def seeded_pages(spark):
    words = "cheap meds buy online garden flower house green river stone"
    html = f"<html><script>spamcode()</script><p>{(words + ' ') * 5}</p></html>"
    bad = [f"http://buycheappills{i}.com/online/{i}" for i in range(20)]
    good = [f"http://www.greengarden{i}.org/river/{i}" for i in range(60)]
    new = ["http://cheapmeds.org/online/2", "http://stonehouse.org/river/7", "http://spam-farm.net/x"]
    return spark.createDataFrame([(i, u, html) for i, u in enumerate([*bad, *good, *new])], "page_id long, url string, html string")


def test_segmented_words_carry_the_verdict(spark):
    rows = {r["url"]: r for r in U.judge_urls(seeded_pages(spark)).collect()}
    assert rows["http://buycheappills3.com/online/3"]["host_words"] == ["buy", "cheap", "pills", "0", "com"]
    assert rows["http://cheapmeds.org/online/2"]["host_words"] == ["cheap", "meds", "org"]
    # neither has a seed word: the company of the words decides
    assert rows["http://cheapmeds.org/online/2"]["verdict"] == "block"
    assert rows["http://stonehouse.org/river/7"]["verdict"] == "allow"
    assert all(r["verdict"] == ("block" if "pills" in u or "spam" in u or "meds" in u else "allow") for u, r in rows.items())
    # the rule has the last word
    ruled = U.judge_urls(seeded_pages(spark), [("allow", "com/")]).where("url like '%pills3.com%'").first()
    assert (ruled["rule"], ruled["verdict"]) == ("com/", "allow") and ruled["odds"] > 0


def test_bayes_equals_counting(spark):
    pages = seeded_pages(spark)
    rows = U.judge_urls(pages).collect()
    tokens = {r["url"]: ["h:" + w for w in r["host_words"]] + ["p:0" if t.isdigit() else "p:" + t for t in re.findall("[a-z]+|[0-9]+", r["path"])] for r in rows}
    bad = {u for u, t in tokens.items() if {x[2:] for x in t} & set(U.SEEDS)}
    count = lambda urls: {t: sum(tokens[u].count(t) for u in urls) for t in {x for ts in tokens.values() for x in ts}}
    b, a = count(bad), count(set(tokens) - bad)
    size = len(b) + 1
    for r in rows:
        want = np.log(len(bad) / (len(tokens) - len(bad)))
        for t in tokens[r["url"]]:
            want += np.log((b[t] + 1) / (sum(b.values()) + size)) - np.log((a[t] + 1) / (sum(a.values()) + size))
        assert r["odds"] == pytest.approx(want)


def test_script_and_markup_are_not_words(spark):
    pages = seeded_pages(spark).withColumn("__h", F.lit("x"))
    logs = U.fit_segmenter(pages, F.col("__h")).logs
    assert "garden" in logs and "spamcode" not in logs and "html" not in logs


def test_odd_rows(spark):
    assert U.judge_urls(empty_documents(spark).selectExpr("doc_id as page_id", "text as url", "text as html")).collect() == []
    clash = spark.createDataFrame([(None, "http://a.net/", None, "v")] * 3, "page_id long, url string, html string, Verdict string")
    rows = U.judge_urls(clash, URL_RULES).collect()
    assert [(r["page_id"], r["verdict"]) for r in rows] == [(None, "block")] * 3
    blank = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert U.judge_urls(blank, URL_RULES).first()["verdict"] == "allow"


def test_rule_ties_and_order(spark):
    host, path = F.lit("a.b.net"), F.lit("/xy/z")
    pick = lambda rules: spark.range(1).select(*(c.alias(n) for n, c in zip("rv", U.rule_verdict(host, path, rules)))).first()
    assert tuple(pick([("block", "net/"), ("allow", "b.net/x")])) == ("b.net/x", "allow")
    assert tuple(pick([("block", "net/xy/"), ("allow", "b.net/x")])) == ("b.net/x", "allow")
    assert tuple(pick([])) == (None, None)


def test_rare_words_and_tokens_count_in_full(spark):
    """Plain counting on over 1.2 million tokens, most of the different ones less than a millionth of all."""
    path = "concat_ws('/', transform(sequence(1, 60), k -> if(k < 40, 'the', concat('w', translate(cast(id * 60 + k as string), '0123456789', 'abcdefghij')))))"
    host = "concat(if(id % 10 = 0, 'casino', 'garden'), 'ingreen', id % 500, '.net')"
    pages = spark.range(20_000).selectExpr(
        "id as page_id", f"concat('http://', {host}, '/', if(id % 10 = 0, 'onlybad', if(id < 15, 'fewclean', 'x')), '/', {path}) as url",
        "if(id = 7, 'ingreen', repeat('garden the green ', 20)) as html")
    rows = U.judge_urls(pages).collect()
    tokens = [["h:" + w for w in r["host_words"]] + ["p:0" if t.isdigit() else "p:" + t for t in re.findall("[a-z]+|[0-9]+", r["path"])] for r in rows]
    assert sum(map(len, tokens)) > 1_000_000
    # one of 1.2 million words of all pages, and likelier than two words
    assert all(r["host_words"][:2] == [r["host"][:6], "ingreen"] for r in rows)
    b, a = {}, {}
    for t in tokens:
        for w in t:
            of = b if "h:casino" in t else a
            of[w] = of.get(w, 0) + 1
    size, n_bad = len(b.keys() | a.keys()) + 1, sum("h:casino" in t for t in tokens)
    nb, na = sum(b.values()) + size, sum(a.values()) + size
    for r, t in zip(rows, tokens):
        want = np.log(n_bad / (len(rows) - n_bad)) + sum(np.log((b.get(w, 0) + 1) / nb) - np.log((a.get(w, 0) + 1) / na) for w in t)
        assert r["odds"] == pytest.approx(want)


def test_what_is_sent_and_what_is_joined_changes_nothing(spark):
    pages = seeded_pages(spark).union(spark.read.parquet(f"{SF}/pages.parquet"))
    key = lambda rows: sorted((r["page_id"], r["url"], r["host_words"], r["odds"], r["verdict"]) for r in rows)
    want = key(U.judge_urls(pages, common=0.0).collect())
    assert key(U.judge_urls(pages, common=2.0).collect()) == want == key(U.judge_urls(pages).collect())
