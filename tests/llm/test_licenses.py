"""License windows against a scan of every window."""

import math
import random
import re

from faultline.llm import licenses
from faultline.llm.queries import op6_licenses


def shingles(text, size=5):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


def brute(text, templates):
    """(template, best containment) over all windows of the class of each template."""
    own, out = shingles(text), set()
    for k, (_, t) in enumerate(templates):
        want = set(shingles(t))
        if not want:
            continue
        step = 1 << (len(want).bit_length() - 1)
        size = 3 * step if step > 1 else 1
        best = max(
            (len(want & set(own[p : p + size])) / len(want) for p in range(0, len(own), step)),
            default=0,
        )
        if best >= 0.75:
            out.add((k, round(best, 9)))
    return out


def got(df):
    best = {}
    for r in df.collect():
        found = {}
        for m in r.matches:
            found[m.template] = max(found.get(m.template, 0), round(m.containment, 9))
        best[r.doc_id] = set(found.items())
    return best


def test_against_every_window(spark):
    rng, rows = random.Random(1), []
    for k in range(120):
        words = [rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: brute(t, licenses.TEMPLATES) for k, t in rows}
    assert got(licenses.scan_licenses(docs)) == want
    assert sum(map(len, want.values())) > 60


def test_odd_rows(spark):
    notice = "Released under the MIT License."
    texts = [None, "", "...", notice, notice, "x " * 100000 + notice, "released under the mit"]
    docs = spark.createDataFrame(
        [(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, matches int"
    )
    rows = {r.doc_id: r.matches for r in licenses.scan_licenses(docs).collect()}
    assert [rows[k] for k in (0, 1, 2, 6)] == [[], [], [], []]
    assert rows[3] == rows[4] and [m.license for m in rows[3]] == ["MIT"]
    assert [(m.license, m.start) for m in rows[5]] == [("MIT", 100000)]
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
    assert licenses.scan_licenses(docs, templates=[]).where("size(matches) > 0").count() == 0


def test_bands_reach_the_promised_probability():
    bands = licenses.Bands(licenses.TEMPLATES, 0.75, 1e-6, 5)
    for k, own in enumerate(bands.sets):
        j = bands.level[k]
        window = 3 << j if j else 1
        low = bands.needed(k) / (window + len(own) - bands.needed(k))
        assert low >= 1 or (1 - low) ** bands.bands[j] <= 1e-6
        assert math.log2(len(own)) < j + 1


def test_query_finds_the_lines(spark, sf):
    rows = {r.doc_id: r for r in op6_licenses(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = {n for n, t in licenses.TEMPLATES if t.rstrip(".") in (d.text or "")}
        assert want <= set(rows[d.doc_id].licenses)
        if not re.search("licen[cs]e", d.text or "", re.IGNORECASE):
            assert rows[d.doc_id].n_matches == 0
