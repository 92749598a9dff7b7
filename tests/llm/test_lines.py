"""Repeated line runs against brute force."""

import random
import re

import pytest

from faultline.llm import lines


def brute(rows, min_words=5):
    seen, gone, texts = {}, {}, {}
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        texts[doc] = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    for size in range(1, max(map(len, texts.values()), default=0) + 1):
        for doc, own in texts.items():
            for p in range(len(own) - size + 1):
                window = tuple(own[p : p + size])
                first = seen.setdefault(window, (doc, p))
                words = sum(len(re.findall("[^\x20\x09-\x0d]+", x)) for x in window)
                if first < (doc, p) and words >= min_words:
                    gone.setdefault(doc, set()).update(range(p, p + size))
    out = []
    for doc, text in rows:
        kept, p = [], 0
        for x in (text or "").split("\n"):
            worded = bool(re.search("[^\x20\x09-\x0d]", x))
            if not (worded and p in gone.get(doc, ())):
                kept.append(x)
            p += worded
        n = len(texts.get(doc, ()))
        out.append((doc, None if text is None else "\n".join(kept), n, len(gone.get(doc, ()))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x") for i, t in rows], "doc_id long, text string, runs string"
    )


@pytest.mark.parametrize("min_words", [1, 5, 12])
def test_random_lines(spark, min_words):
    rng = random.Random(min_words)
    pool = ["a", "b c", "d e f", "g h i j k", "", "  ", "l\r", "é ü"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(14)))) for k in range(60)]
    rows += [(k + 60, t) for k, (_, t) in enumerate(rows[:10])]
    rng.shuffle(rows)
    found = lines.drop_repeated_lines(frame(spark, rows), min_words=min_words)
    assert got(found) == brute(rows, min_words)


def test_runs_name_their_source(spark):
    rows = [(1, "x\nfive words are in here\ny"), (2, "new\nfive words are in here\ny\nend")]
    runs = {r.doc_id: r.runs for r in lines.drop_repeated_lines(frame(spark, rows)).collect()}
    assert runs[1] == [] and [tuple(x) for x in runs[2]] == [(1, 2, 1, 1)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "one two three four five"), (4, "x " * 200000)]
    rows += [(5, "one two three four five"), (5, "one two three four five"), (6, "x " * 200000)]
    found = got(lines.drop_repeated_lines(frame(spark, rows)))
    want = [(1, None, 0, 0), (2, "", 0, 0), (3, "\n\n", 0, 0), (None, rows[3][1], 1, 0)]
    want += [(4, rows[4][1], 1, 0), (5, rows[5][1], 1, 0), (5, rows[5][1], 1, 0), (6, "", 1, 1)]
    assert found == sorted(want, key=str)
    assert lines.drop_repeated_lines(frame(spark, [])).collect() == []


def brute_runs(rows, min_words):
    """Deleted lines (document, place) over runs of every length."""
    texts = {d: [x for x in t.split("\n") if x.strip()] for d, t in sorted(rows)}
    seen, gone = {}, set()
    for size in range(1, max(map(len, texts.values())) + 1):
        for doc, own in texts.items():
            for p in range(len(own) - size + 1):
                window = tuple(own[p : p + size])
                first = seen.setdefault(window, (doc, p))
                if first < (doc, p) and sum(len(x.split()) for x in window) >= min_words:
                    gone.update((doc, k) for k in range(p, p + size))
    return gone


@pytest.mark.parametrize("min_words", [1, 5, 12])
def test_runs_of_every_length(spark, min_words):
    rng = random.Random(40 + min_words)
    pool = ["a", "b", "c d", "e f", "g h i", "j k l m n o"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(16)))) for k in range(50)]
    menu = [f"item{k}" for k in range(7)]
    for n in (5, 6, 7):
        rows += [(100 * n + k, "\n".join([f"top{n}{k}", *menu[:n], f"end{n}{k}"])) for k in range(2)]
    for n, run in ((8, ["one two", "three four", "five six"]), (9, ["r s t u v w", "x", "y"])):
        rows += [(100 * n + k, "\n".join([f"top{n}{k}", *run, f"end{n}{k}"])) for k in range(2)]
    found = lines.drop_repeated_lines(frame(spark, rows), min_words=min_words).collect()
    gone = {(r.doc_id, p) for r in found for x in r.runs for p in range(x["first"], x["first"] + x["lines"])}
    assert gone == brute_runs(rows, min_words)
    if min_words == 5:
        assert {(801, 1), (801, 2), (801, 3), (901, 3), (501, 5)} <= gone
