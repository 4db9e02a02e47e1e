import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import truncation as tr


@pytest.mark.parametrize(
    ("text", "kind"),
    [("It ends.", "strong"), ("It ends.”", "strong"), ("It ends!! 🙂", "strong"), ("It ends.​", "strong"), ("It ends. (sic)", "strong"), ("这是结束。", "strong"), ("It goes on…", "ell"), ("It goes on...", "ell"), ("It goes [...]", "mark"), ("It goes,", "pause"), ("It go-", "dash"), ("It go�", "bad"), ("It go&am", "entity"), ("It goes <b", "entity"), ("It goes", "none"), ("14,3", "none"), ("<b>Done.</b>", "strong")],
)
def test_closing(text, kind):
    assert tr.closing(text)[0] == kind


def test_very_long_ends_take_linear_time():
    import time

    began = time.time()
    for text in ("." * 300_000, "x" + " " * 300_000 + "y", " " * 300_000 + "[", "a [" * 100_000, "”" * 300_000, "<" * 300_000, "x" + "…" * 300_000, "&" * 300_000, "x" * 300_000 + "\n" * 300_000):
        assert 0.0 <= tr.probability(text, ([120], [400]), 0.1, tr.np.zeros(tr.DIMENSIONS)) <= 1.0
        tr.examples(text, "It ends.", ([120], []), [0.5], 0.1)
    assert time.time() - began < 20


def test_cut_length():
    assert [tr.cut_length(t, "chars") for t in ("abc", "abc…", "abc...", "abc [...]", "abc�", "")] == [3, 3, 3, 3, 3, 0]
    assert tr.cut_length("é�", "bytes") == 2


def test_limits():
    rnd = random.Random(1)
    hist = {}
    for _ in range(400):
        hist[n] = hist.get(n := rnd.randrange(40, 300), 0) + 1
    assert tr.find_limits(hist) == []
    hist[215] = hist.get(215, 0) + 60
    assert [x for _, x, _ in tr.find_limits(hist)] == [215]
    for i in range(9):
        hist[112 + i] = hist.get(112 + i, 0) + 12
    for i in range(3):  # a soft limit ends sharply
        hist[121 + i] = 0
    found = sorted(x for _, x, _ in tr.find_limits(hist))
    assert found[-1] == 215 and any(118 <= x <= 122 for x in found)
    assert tr.find_limits({}) == []


def corpus(n=2500, seed=3):
    """Sentences of a small grammar: intact, without closing punctuation, and cut."""
    rnd = random.Random(seed)
    who = ["the clearing house", "the small broker", "the audit team", "a data vendor", "the night batch", "my neighbour"]
    does = ["publishes the full table", "rejects the late entry", "records every change", "splits the large order", "keeps the old price", "waits for an update"]
    when = ["after the close", "on Monday morning", "under heavy load", "since last week", "in both regions"]
    out = []
    for i in range(n):
        text = " ".join((lambda s: s[0].upper() + s[1:] + ".")(f"{rnd.choice(who)} {rnd.choice(does)} {rnd.choice(when)}") for _ in range(rnd.randrange(1, 4)))
        kind = rnd.random()
        source = rnd.choice(["a", "b"])
        if kind < 0.1:
            out.append((i, text[:-1], source, 0))
        elif kind < 0.25:
            piece = text[: rnd.randrange(5, len(text) - 3)].rstrip(" .")
            out.append((i, piece + rnd.choice(["", "…", " [...]", "-", "�"]), source, int(not piece.endswith(tuple(when)) or piece[-1] == ".")))
        else:
            out.append((i, text, source, 0))
    return out


def test_held_out_accuracy(spark):
    """Trained on intact texts of the corpus only; scored on real cuts it has not seen."""
    data = corpus()
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, cut int")
    got = {r.doc_id: r.p_cut > 0.5 for r in tr.score(df, sample_rows=1500).collect()}
    truth = {d: bool(c) for d, _, _, c in data}
    hits = sum(got[d] and truth[d] for d in truth)
    assert hits / sum(truth.values()) > 0.9
    assert hits / sum(got.values()) > 0.9


def test_repeatable(spark):
    df = spark.createDataFrame(corpus(300), "doc_id bigint, text string, source string, cut int")
    a, b = (sorted(map(tuple, tr.score(x, sample_rows=200).collect())) for x in (df, df.repartition(5)))
    assert a == b


def test_edges(spark):
    data = [(1, None, "a"), (2, "", "a"), (3, " 　​", None), (4, "x" * 300_000, "a"), (5, "Fine.", None), (5, "Fine.", None), (None, "Fine.", "b")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").withColumn("p_cut", F.lit("clash")).withColumn("open_rate", F.lit(1))
    got = tr.score(df)
    p = [(r.doc_id, r.source, r.p_cut) for r in got.collect()]
    assert len(p) == 7 and all(x == 0.0 for d, _, x in p if d in (1, 2, 3))
    assert tr.found(got).where("doc_id in (1, 2, 3, 5)").count() == 0
    rates = {r.source: (r.n_docs, r.n_cut) for r in tr.rates(got).collect()}
    assert rates[None][0] == 3 and rates["b"] == (1, 0)
    assert tr.score(df.limit(0)).count() == 0


def test_sources_beyond_the_bound_are_joined(spark):
    df = spark.createDataFrame(corpus(200), "doc_id bigint, text string, source string, cut int")
    near, far = (sorted(map(tuple, tr.score(df, sample_rows=100, max_sources=m).collect())) for m in (10, 1))
    assert near == far


def facts_of(df):
    return tr.text_facts(df.select("doc_id", "source", "text"), "bigint", 1.0)


def test_a_source_may_have_a_limit_in_either_unit(spark):
    """Each is found in its own unit, and the lengths it makes pile up in the other unit are no limits."""
    rnd = random.Random(9)
    word = lambda ascii_: "".join(rnd.choice("abcdefgh" if ascii_ else "абвгдежз") for _ in range(rnd.randrange(3, 9)))
    data = []
    for i in range(1500):
        text = " ".join(word(i % 2) for _ in range(rnd.randrange(5, 60)))
        if i % 3 == 0:
            text = text[:90]
        elif i % 3 == 1:
            text = text.encode()[:260].decode("utf-8", "ignore")
        else:
            text += "."
        data.append((i, text, "s"))
    got = tr.source_stats(facts_of(spark.createDataFrame(data, "doc_id bigint, text string, source string"))).first()
    assert list(got.char_limits) == [90] and list(got.byte_limits) == [260]
    assert len(got.limit_shares) == 2 and 0.2 < sum(got.limit_shares) <= 1.0


def test_cuts_at_limits_are_measured():
    rnd = random.Random(1)
    text, other = "The night batch keeps the old price.", "The audit team records every change in both regions."
    for limits in (([60], []), ([], [60]), ([20, 60], [])):
        made = [p for _ in range(40) for p in tr.cut_at_limits(text, other, limits, [0.5] * 2, rnd)]
        near = Counter(tr._near(tr.cut_length(p, unit), x) for p in made for unit, x in zip(("chars", "bytes"), limits) if x)
        assert set(near) <= {"at", "below"} and near["at"] > 0 and near["below"] > 0
    assert tr.cut_at_limits(text, other, ([60], []), [0.0], rnd) == []


def mostly_cut(n=1200, seed=5, limit=40):
    """Source ``c`` cuts at a field limit, which most of its texts exceed; ``h`` never closes its texts and has no limit."""
    rnd = random.Random(seed)
    out = []
    for i, text, source, cut in corpus(n, seed):
        kind = rnd.random()
        if kind < 0.4:
            whole = text if not cut and text.endswith(".") else "It ends."
            out.append((i, whole[:limit], "c", int(len(whole) > limit)))
        elif kind < 0.6 and not cut:
            out.append((i, text.split(".")[0], "h", 0))
        else:
            out.append((i, text, source, cut))
    return out


def test_a_source_that_cuts_most_of_its_texts_keeps_its_limit(spark):
    data = mostly_cut()
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, cut int")
    stats = {r.source_key: r for r in tr.source_stats(facts_of(df)).collect()}
    assert stats["c"].open_rate > tr.NATURAL_OPEN_RATE and stats["h"].open_rate > tr.NATURAL_OPEN_RATE
    assert (list(stats["c"].char_limits), list(stats["h"].char_limits) + list(stats["h"].byte_limits)) == ([40], [])
    found = {r.doc_id for r in tr.found(tr.score(df, sample_rows=1200)).collect()}
    hit = [i in found for i, text, s, cut in data if s == "c" and cut]
    false = [i in found for i, text, s, cut in data if s in "ch" and not cut]
    assert sum(hit) / len(hit) > 0.9 and sum(false) / len(false) < 0.1


def test_limits_of_texts_that_are_open_by_nature():
    rnd = random.Random(2)
    body = Counter(max(3, round(rnd.gauss(40, 14))) for _ in range(4000))
    assert tr.find_limits(dict(body), natural=True) == []
    assert tr.find_limits({x: n for x, n in ((4, 224), (5, 180), (6, 30), (9, 40), (12, 75), (15, 110), (18, 100))}, natural=True) == []
    assert [x for _, x, _ in tr.find_limits(dict(body + Counter({48: 600})), natural=True)] == [48]
    soft = Counter(min(x, 50 - rnd.randrange(tr.SOFT)) if x > 50 else x for x in (max(3, round(rnd.gauss(60, 20))) for _ in range(4000)))
    found = [x for _, x, _ in tr.find_limits(dict(soft), natural=True)]
    assert found == [50]
