"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods, languages by penalised likelihood.

The model is a table of log probabilities of hashed byte trigrams (lower-cased; everything but letters is one break)
for each language, with add-one smoothing. It is fitted on a bounded sample of the labelled texts, each distinct text once: those of a
language whose hash is below a share that makes `per_language` of them expected; below the bound all take part.

A document is a bag of words; a word's likelihood under a language is the product over its trigrams. EM estimates the
language proportions of the document from the words' likelihoods. The set of languages grows from the best single one,
adding the language that raises the likelihood most, for as long as the gain beats the penalty
(half of log(number of words) for each added proportion, times PENALTY). The prediction is the language with the
largest proportion of the chosen set, the score its proportion times its posterior against the other languages.

Cases: null texts and texts without a letter are `und` with score 0. Ties go to the language that comes first by code
point. Very short texts are decided by their few trigrams, long ones in whole: beyond PIECE bytes piece by piece, so that
memory grows by a few bytes a word and language. Rows with a null lang train nothing;
with no labelled row at all everything is `und`. A null doc_id trains nothing and is held out as false. Rows that
repeat are predicted alike. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import pieces, quoted, text_buffer, text_pieces

BUCKETS = 1 << 16
#: Bound on the labelled documents of one language that the model is fitted on.
PER_LANGUAGE = 4_000
EM_ROUNDS = 8
PENALTY = 2.0
#: Bytes of a long text that are worked at once.
PIECE = 1 << 20
UND = "und"

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
HAS_LETTER = r"\p{L}"


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams of all words (with their breaks), where each word starts in them, the word's document, the words' offsets by document."""
    n = len(raw)
    low = _FOLD[raw]
    letter = _LETTER[low]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[:1], before[1:] = False, letter[:-1]
    after[-1:], after[:-1] = False, letter[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    c = np.where(letter, low, 0x20).astype(np.uint32)
    left = np.where(before, np.r_[np.uint32(0x20), c[:-1]], np.uint32(0x20))
    right = np.where(after, np.r_[c[1:], np.uint32(0x20)], np.uint32(0x20))
    code = (left << np.uint32(16)) | (c << np.uint32(8)) | right
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16))[letter]
    start = np.flatnonzero(letter & ~before)
    at = np.cumsum(letter) - 1
    return bucket, at[start], np.searchsorted(start, offsets), start


def _count(languages: list[str]):
    """lang, text -> language index, bucket, count."""
    index = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in text_pieces(batches):
            which = np.array([index[x] for x in batch.column("lang").to_pylist()])
            for i in np.unique(which):
                raw, offsets = text_buffer(batch.column("text").filter(pa.array(which == i)))
                for a, b in pieces(offsets):
                    at = offsets[a : b + 1]
                    if at[-1] > at[0]:
                        total[i] += np.bincount(_trigrams(raw[at[0] : at[-1]], at - at[0])[0], minlength=BUCKETS)
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(total[i, k], pa.int64())], names=["i", "k", "n"])

    return count


def crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the table of log probabilities, buckets x languages."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc_of_id(), F.lit(4)) != 2)).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = sorted((r["lang"], r["n"]) for r in train.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect())  # one row for each language
    languages = [x for x, _ in sizes]
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    # a hash below the language's share is a bounded sample that doesn't depend on the order of rows
    share = F.create_map(*[F.lit(v) for x, n in sizes for v in (x, min(1.0, per_language / n))])
    sample = train.where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])
    counts = sample.select("lang", "text").mapInArrow(_count(languages), "i int, k int, n long").groupBy("i", "k").agg(F.sum("n").alias("n")).toPandas()  # buckets x languages at most
    table = np.ones((BUCKETS, len(languages)))
    np.add.at(table, (counts["k"].to_numpy(int), counts["i"].to_numpy(int)), counts["n"].to_numpy(float))
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def _segment_sum(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows of x between offsets; empty segments are zero."""
    total = np.zeros((len(offsets) - 1, x.shape[1]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        total[full] = np.add.reduceat(x, offsets[full], axis=0)
    return total


def _proportions(like: np.ndarray, doc: np.ndarray, offsets: np.ndarray, start: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once. like: words x languages, scaled; start: documents x languages, 0 for languages outside the set."""
    p, n = start, np.maximum(np.diff(offsets), 1)[:, None]
    for _ in range(rounds):
        r = p[doc] * like
        r /= r.sum(axis=1, keepdims=True)
        p = _segment_sum(r, offsets) / n
    mixed = np.log((p[doc] * like).sum(axis=1, keepdims=True))
    return p, _segment_sum(mixed, offsets)[:, 0]


def mixtures(logs: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words x languages log-likelihoods: documents' proportions, posterior of single languages, mean log-likelihood of the best."""
    n_docs, n_lang = len(offsets) - 1, logs.shape[1]
    words = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), words)
    top = logs.max(axis=1, keepdims=True)
    like = np.maximum(np.exp((logs - top).astype(np.float64)), 1e-12)
    single = _segment_sum(logs.astype(np.float64), offsets)
    posterior = np.exp(single - single.max(axis=1, keepdims=True))
    posterior /= posterior.sum(axis=1, keepdims=True)
    base = _segment_sum(top.astype(np.float64), offsets)[:, 0]
    best = single.argmax(axis=1)
    share = np.zeros((n_docs, n_lang))
    share[np.arange(n_docs), best] = 1.0
    score = single.max(axis=1) - base  # log-likelihood relative to each word's best language
    cost = penalty * 0.5 * np.log(np.maximum(words, 2))
    full, _ = _proportions(like, doc, offsets, np.full((n_docs, n_lang), 1 / n_lang))
    open_ = np.flatnonzero((words > 1) & (n_lang > 1))
    chosen = share > 0
    for size in range(2, n_lang + 1):
        if not len(open_):
            break
        # the candidate to add is the language outside the set with the largest proportion under all languages
        rest = np.where(chosen[open_], -1.0, full[open_])
        add = rest.argmax(axis=1)
        trial = chosen[open_].copy()
        trial[np.arange(len(open_)), add] = True
        pick = np.isin(doc, open_)
        off = np.r_[0, np.cumsum(words[open_])]
        d = np.repeat(np.arange(len(open_)), words[open_])
        p, value = _proportions(like[pick], d, off, trial / trial.sum(axis=1, keepdims=True))
        better = value - score[open_] > cost[open_]
        won = open_[better]
        chosen[won], share[won], score[won] = trial[better], p[better], value[better]
        open_ = won
    return share, posterior, single.max(axis=1)


def _runs(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about PIECE bytes that end where a word ends."""
    a = 0
    while a < len(raw):
        b = min(a + PIECE, len(raw))
        while b < len(raw) and _LETTER[_FOLD[raw[b]]]:
            near = np.flatnonzero(~_LETTER[_FOLD[raw[b : b + PIECE]]])
            b = b + int(near[0]) if len(near) else min(b + PIECE, len(raw))
        yield raw[a:b]
        a = b


def mixture_of_runs(runs: list[np.ndarray], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, float]:
    """mixtures() of one document whose words x languages log-likelihoods come in runs: proportions, posterior, log-likelihood of the best."""
    n_lang, words = runs[0].shape[1], sum(map(len, runs))
    single = sum(x.astype(np.float64).sum(axis=0) for x in runs)
    posterior = np.exp(single - single.max())
    posterior /= posterior.sum()
    like = lambda x: np.maximum(np.exp((x - x.max(axis=1, keepdims=True)).astype(np.float64)), 1e-12)

    def proportions(p: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(EM_ROUNDS):
            total = np.zeros(n_lang)
            for x in runs:
                r = p * like(x)
                total += (r / r.sum(axis=1, keepdims=True)).sum(axis=0)
            p = total / words
        return p, sum(float(np.log((p * like(x)).sum(axis=1)).sum()) for x in runs)

    base = sum(float(x.max(axis=1).astype(np.float64).sum()) for x in runs)
    chosen = np.zeros(n_lang, bool)
    chosen[single.argmax()] = True
    share, score = chosen.astype(float), float(single.max()) - base
    full, _ = proportions(np.full(n_lang, 1 / n_lang))
    while words > 1 and not chosen.all():
        trial = chosen.copy()
        trial[np.where(chosen, -1.0, full).argmax()] = True
        p, value = proportions(trial / trial.sum())
        if value - score <= penalty * 0.5 * np.log(max(words, 2)):
            break
        chosen, share, score = trial, p, value
    return share, posterior, float(single.max())


def _predict(languages: list[str], table: "pyspark.Broadcast"):  # noqa: F821
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table.value
        for batch in text_pieces(batches):
            raw, offsets = text_buffer(batch.column("text"))
            known = np.array(batch.column("letters").to_pylist(), bool) & bool(languages)
            pred, score, fit_ = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b in pieces(offsets, PIECE):
                at = offsets[a : b + 1]
                if at[-1] == at[0] or not languages:
                    continue
                if b - a == 1 and at[-1] - at[0] > 2 * PIECE:
                    runs, n_grams = [], 0
                    for part in _runs(raw[at[0] : at[-1]]):
                        bucket, first, _, _ = _trigrams(part, np.array([0, len(part)]))
                        if len(first):
                            runs.append(np.add.reduceat(logp[bucket], first, axis=0))
                            n_grams += len(bucket)
                    if runs and known[a]:
                        share, posterior, best_log = mixture_of_runs(runs)
                        i = int(share.argmax())
                        pred[a], fit_[a] = languages[i], best_log / n_grams
                        score[a] = np.clip(share[i] * (1.0 if share.max() < 1 else posterior[i]), 0, 1)
                    continue
                bucket, first, off, _ = _trigrams(raw[at[0] : at[-1]], at - at[0])
                if not len(first):
                    continue
                logs = np.add.reduceat(logp[bucket], first, axis=0)
                share, posterior, single = mixtures(logs, off)
                best = share.argmax(axis=1)
                row = np.arange(b - a)
                ok = known[a:b] & (np.diff(off) > 0)
                pred[a:b][ok] = np.array(languages, object)[best[ok]]
                value = share[row, best] * np.where(share.max(axis=1) < 1, 1.0, posterior[row, best])
                score[a:b][ok] = np.clip(value[ok], 0, 1)
                grams = np.add.reduceat(np.r_[np.diff(np.r_[first, len(bucket)]), 0], np.minimum(off[:-1], len(first))) * (np.diff(off) > 0)
                fit_[a:b][ok] = single[ok] / np.maximum(grams[ok], 1)
            cols = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "letters")}
            cols |= {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "mean_log": pa.array(fit_)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return predict


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mean_log (log-likelihood for a trigram under the best language)."""
    languages, logp = fit(docs, per_language)
    table = docs.sparkSession.sparkContext.broadcast(logp)  # BUCKETS x languages of 4 bytes
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("letters"))
    return cols.mapInArrow(_predict(languages, table), "doc_id long, held_out boolean, lang_pred string, score double, mean_log double")


def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs that get a language, as they are; only `und` is rejected, never a label that differs."""
    languages, logp = fit(docs, per_language)
    predict = _predict(languages, docs.sparkSession.sparkContext.broadcast(logp))
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches):
            for found in predict(iter([batch.select(["text", "letters"])])):
                known = pa.array([x != UND for x in found.column("lang_pred").to_pylist()], pa.bool_())
                yield batch.select(["row", "text"]).filter(known)

    cols = docs.select(F.struct(*others).alias("row"), "text", F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("letters"))
    kept = cols.mapInArrow(keep, cols.select("row", "text").schema)
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def accuracy(found: DataFrame, docs: DataFrame) -> pd.DataFrame:
    """Share of right predictions on held-out rows, by language; for tests."""
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    return joined.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n")).toPandas()
