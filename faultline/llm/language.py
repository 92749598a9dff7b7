"""Word-level language identification with a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text as tx

UNKNOWN = "und"
FEATURE_BITS = 16
LEXICON_BITS = 16
CHAIN = 128  # words of a sequence; a longer text is several sequences
ODD = np.uint64(0x9E3779B97F4A7C15)

#: A-Z, a-z and bytes of letters beyond ASCII
LETTERS = tx.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass
class Model:
    """Weights of affix and n-gram features, lexicon and transitions, per language."""

    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # buckets x languages: log-odds of the words seen in training
    lexicon_weight: float
    transitions: np.ndarray  # log scores, from x to


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 bytes as small letters."""
    data = tx.LOWER[data]
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    second &= (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data[second] += 32
    return data


def _bucket(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * ODD) >> np.uint64(64 - bits)).astype(np.int32)


def word_features(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Affix buckets (words x 6), trigram buckets, place of each word's first, lexicon bucket."""
    n = len(data)
    padded = np.zeros(n + 4, np.uint64)
    length = ends - starts
    affixes = np.empty((len(starts), 6), np.int32)
    padded[:n] = data
    for k in range(3):
        have = length > k
        if k:
            code = (code << np.uint64(8)) | np.where(have, padded[starts + k], 0)
            back = (back << np.uint64(8)) | np.where(have, padded[ends - 1 - k * have], 0)
        else:
            code = padded[starts].copy()
            back = padded[ends - 1].copy()
        affixes[:, k] = _bucket(code * np.uint64(8) + np.uint64(k), FEATURE_BITS)
        affixes[:, 3 + k] = _bucket(back * np.uint64(8) + np.uint64(3 + k), FEATURE_BITS)
    # trigrams of the bytes of each word, with a zero byte on both ends
    at = np.repeat(starts, length) + tx.ranges(length)
    first = np.concatenate([[0], np.cumsum(length)])
    middle = padded[at]
    before = np.zeros(len(at), np.uint64)
    before[1:] = middle[:-1]
    before[first[:-1]] = 0
    after = np.zeros(len(at), np.uint64)
    after[:-1] = middle[1:]
    after[first[1:] - 1] = 0
    gram = (before << np.uint64(16)) | (middle << np.uint64(8)) | after
    grams = _bucket(gram * np.uint64(8) + np.uint64(7), FEATURE_BITS)
    words = tx.span_hashes(data, starts, ends)
    return affixes, grams, first[:-1], (words >> np.uint64(64 - LEXICON_BITS)).astype(np.int32)


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of each language for each word (words x languages)."""
    affixes, grams, first, words = word_features(data, starts, ends)
    out = model.lexicon[words] * model.lexicon_weight
    for k in range(affixes.shape[1]):
        out += model.weights[affixes[:, k]]
    out += np.add.reduceat(model.weights[grams], first, axis=0)
    return out


def sequences(first: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the sequences, longest first; no sequence spans two texts."""
    counts = np.diff(first)
    parts = -(-counts // size)
    inner = tx.ranges(parts)
    starts = np.repeat(first[:-1], parts) + inner * size
    lengths = np.minimum(np.repeat(counts, parts) - inner * size, size)
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def marginals(
    scores: np.ndarray, transitions: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all sequences at once.

    Returns the probability of each language for each word, and the expected number
    of each transition.
    """
    steps, labels = int(lengths.max(initial=0)), scores.shape[1]
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    forward = np.empty_like(local)
    backward = np.ones_like(local)
    for t in range(steps):
        now = starts[: active[t]] + t
        value = local[now]
        if t:
            value = value * (forward[now - 1] @ step)
        forward[now] = value / np.maximum(value.sum(axis=1, keepdims=True), 1e-30)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 2, -1, -1):
        now = starts[: active[t + 1]] + t
        onward = local[now + 1] * backward[now + 1]
        value = onward @ step.T
        backward[now] = value / np.maximum(value.sum(axis=1, keepdims=True), 1e-30)
        both = forward[now][:, :, None] * step * onward[:, None, :]
        pairs += (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
    out = forward * backward
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30), pairs


def _lexicon_counts(train: DataFrame) -> DataFrame:
    """Words of all training texts by lexicon bucket and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, "text"):
                data = lower_bytes(data)
                starts, ends, first = tx.word_bounds(data, offsets, LETTERS)
                words = tx.span_hashes(data, starts, ends) >> np.uint64(64 - LEXICON_BITS)
                names = np.array(batch.column("lang")[row:end].to_pylist(), object)
                of_word = np.repeat(names, np.diff(first))
                for name in set(names):
                    counts = np.bincount(
                        words[of_word == name].astype(np.int64), minlength=1 << LEXICON_BITS
                    )
                    totals[name] = totals.get(name, 0) + counts
        for name, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some)), pa.array(some), pa.array(counts[some])],
                ["lang", "bucket", "n"],
            )

    rows = train.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(
    train: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_documents: int = 4000,
    max_words: int = 64,
    epochs: int = 8,
    seed: int = 7,
) -> Model:
    """Learns the languages of ``lang_col``.

    The lexicon counts the words of all rows. Weights are fitted on a bounded sample of
    about ``max_documents`` texts by their hashes, ``max_words`` words of each from a random
    place, a third of them spliced with words of another row so
    that the transitions learn switches. Rows with a null text or language are left
    out. Without any labelled row the model knows no language.
    """
    train = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counts = _lexicon_counts(train).toArrow()  # at most buckets x languages rows
    names = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((1 << LEXICON_BITS, len(names)))
    number = {name: k for k, name in enumerate(names)}
    if counts.num_rows:
        column = np.array([number[x] for x in counts["lang"].to_pylist()])
        table[np.asarray(counts["bucket"]), column] = np.asarray(counts["n"])
    share = (table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)) if names else table
    logs = np.log(share) if names else share
    lexicon = (logs - logs.mean(axis=1, keepdims=True)) if names else logs
    model = Model(
        names,
        np.zeros((1 << FEATURE_BITS, len(names)), np.float32),
        lexicon.astype(np.float32),
        0.0,
        np.zeros((len(names), len(names)), np.float32),
    )
    if not names:
        return model
    # a stretch of each sampled text, one row per text, so that what is sent is bounded
    span = max_words * 8
    place = F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.length("text") - span, F.lit(1)))
    share = min(1.0, max_documents / max(train.count(), 1))
    sample = (
        train.select(
            F.xxhash64("text").alias("h"),
            F.substring("text", place.cast("int") + 1, F.lit(span)).alias("text"),
            "lang",
        )
        .where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
        .groupBy("h")
        .agg(F.min(F.struct("text", "lang")).alias("row"))
    )
    rows = sample.orderBy("h").limit(max_documents).select("row.text", "row.lang").collect()
    _train(model, [(r.text, number[r.lang]) for r in rows], max_words, epochs, seed)
    return model


def _train(model: Model, rows: list[tuple[str, int]], max_words: int, epochs: int, seed: int):
    rng = np.random.default_rng(seed)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string())], ["text"])
    found, n_words, n_grams = [], 0, 0
    for _, _, data, offsets in tx.text_slices(batch, "text", 1 << 18):
        data = lower_bytes(data)
        starts, ends, first = tx.word_bounds(data, offsets, LETTERS)
        affixes, grams, gram_first, words = word_features(data, starts, ends)
        found.append((affixes, grams, gram_first + n_grams, words, first[:-1] + n_words))
        n_words, n_grams = n_words + len(words), n_grams + len(grams)
    if not n_words:
        return
    affixes, grams, gram_first, words, first = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.append(first, n_words)
    gram_end = np.append(gram_first[1:], len(grams))
    label = np.array([y for _, y in rows])
    known = np.flatnonzero(np.diff(first) > 0)
    size = len(model.languages)
    squares = np.full((len(model.weights), size), 1e-4, np.float32)
    square_step, square_lex = np.full((size, size), 1e-5), 1e-2
    for _ in range(epochs):
        rng.shuffle(known)
        other = rng.permutation(known)
        for at in range(0, len(known), 100):
            chosen, truth, lengths = [], [], []
            for a, b in zip(known[at : at + 100], other[at : at + 100], strict=True):
                mine = np.arange(first[a], min(first[a + 1], first[a] + max_words))
                y = np.full(len(mine), label[a])
                if rng.random() < 0.33:
                    extra = np.arange(first[b], min(first[b + 1], first[b] + max_words // 2))
                    mine = np.concatenate([mine[: max_words // 2], extra])
                    y = np.concatenate([y[: max_words // 2], np.full(len(extra), label[b])])
                chosen.append(mine)
                truth.append(y)
                lengths.append(len(mine))
            order = np.argsort(-np.array(lengths), kind="stable")
            pick = np.concatenate([chosen[k] for k in order])
            gold = np.concatenate([truth[k] for k in order])
            length = np.array(lengths)[order]
            begin = np.concatenate([[0], np.cumsum(length)[:-1]])
            grams_of = gram_end[pick] - gram_first[pick]
            flat = grams[np.repeat(gram_first[pick], grams_of) + tx.ranges(grams_of)]
            bounds = np.concatenate([[0], np.cumsum(grams_of)[:-1]])
            scores = model.lexicon[words[pick]] * model.lexicon_weight
            scores = scores + model.weights[affixes[pick]].sum(axis=1)
            scores += np.add.reduceat(model.weights[flat], bounds, axis=0)
            share, pairs = marginals(scores, model.transitions, begin, length)
            error = -share
            error[np.arange(len(gold)), gold] += 1
            error /= len(gold)
            grad = np.zeros_like(model.weights)
            for k in range(affixes.shape[1]):
                np.add.at(grad, affixes[pick, k], error)
            np.add.at(grad, flat, np.repeat(error, grams_of, axis=0))
            grad -= 1e-6 * model.weights
            squares += grad * grad * len(gold)
            model.weights += 0.3 * grad / np.sqrt(squares)
            inside = np.ones(len(gold), bool)
            inside[begin] = False
            seen = np.zeros((size, size))
            np.add.at(seen, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
            move = (seen - pairs) / len(gold)
            square_step += move * move
            model.transitions += (0.5 * move / np.sqrt(square_step)).astype(np.float32)
            pull = float((error * model.lexicon[words[pick]]).sum())
            square_lex += pull * pull * len(gold)
            model.lexicon_weight += 0.5 * pull / np.sqrt(square_lex)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", prefix: str = ""
) -> DataFrame:
    """Adds lang_pred, score, runs and certainty to every row.

    Every word is labelled by its forward-backward probabilities; ``lang_pred`` is the
    language with the highest mean probability over the words, ``score`` that mean.
    ``runs`` are stretches of words of one language: first word, words, lang.
    ``certainty`` is the mean over the words of their most probable language, so it
    stays high where a text switches between languages. A null text, one without a
    letter, or a model without languages gives ``und``, 0, no runs and 0. Ties go to the first language by name. Columns of the same names are
    replaced unless a ``prefix`` keeps the new ones apart; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + x for x in ("lang_pred", "score", "runs", "certainty")]
    kept = [c for c in docs.columns if c not in names]
    run = pa.list_(
        pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, end, data, offsets in tx.text_slices(batch, text_col):
                part = batch.slice(row, end - row)
                lang, score, runs, certainty = _label(model, part.column(text_col), data, offsets)
                columns = [part.column(c) for c in kept]
                columns += [pa.array(lang, pa.string()), pa.array(score), pa.array(runs, run), pa.array(certainty)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
        + [
            f"`{names[0]}` string, `{names[1]}` double",
            f"`{names[2]}` array<struct<first:int,words:int,lang:string>>",
            f"`{names[3]}` double",
        ]
    )
    return docs.select(*kept).mapInArrow(label, schema)


def _label(model: Model, texts: pa.Array, data: np.ndarray, offsets: np.ndarray):
    n = len(offsets) - 1
    names = np.array([*model.languages, UNKNOWN], object)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    known = seen[offsets[1:]] > seen[offsets[:-1]]
    for d in np.flatnonzero(~known & (np.diff(offsets) > 0)):
        known[d] = _has_letter(texts[int(d)].as_py())
    data = lower_bytes(data)
    starts, ends, first = tx.word_bounds(data, offsets, LETTERS)
    if not len(starts) or not model.languages:
        return names[np.full(n, -1)].tolist(), np.zeros(n), [[] for _ in range(n)], np.zeros(n)
    scores = emissions(model, data, starts, ends)
    share, _ = marginals(scores, model.transitions, *sequences(first))
    total = np.concatenate([np.zeros((1, share.shape[1])), np.cumsum(share, 0, np.float64)])
    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
    known &= np.diff(first) > 0
    best = np.where(known, mean.argmax(axis=1), -1)
    score = np.where(known, np.minimum(mean.max(axis=1), 1.0), 0.0)
    most = np.concatenate([[0.0], np.cumsum(share.max(axis=1), dtype=np.float64)])
    certainty = (most[first[1:]] - most[first[:-1]]) / np.maximum(np.diff(first), 1)
    certainty = np.where(known, np.minimum(certainty, 1.0), 0.0)
    label = share.argmax(axis=1)
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(new)
    words = np.diff(np.append(at, len(label)))
    text = np.searchsorted(first, at, "right") - 1
    runs: list[list] = [[] for _ in range(n)]
    for d, a, w in zip(text.tolist(), at.tolist(), words.tolist(), strict=True):
        if known[d]:
            runs[d].append({"first": a - int(first[d]), "words": w, "lang": names[label[a]]})
    return names[best].tolist(), score, runs, certainty
