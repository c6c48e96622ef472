"""Quality rules by tokeniser fertility.

A public vocabulary says how well a text is made of known pieces: characters per token, the share of
tokens that are single fall-back bytes, and the entropy of its tokens. A text outside of a band is rejected. There
are two kinds of bands:

* Fixed ones per script, since a vocabulary learned mostly from Latin text spells other scripts in more tokens.
* Fitted ones per language (the column `lang_col`; the script where it is null or missing), for characters per
  token. The centre is the median over all texts of that language that pass the base rules. The mean over n
  tokens scatters by 1 / sqrt(n), so a text's deviation is measured as (x / centre - 1) * sqrt(n), and its spread is
  the median of that size, times 1.4826. A text is rejected beyond `reach` spreads, if it is also off by `slack` of the
  centre or more. Medians are exact to a thousandth and not moved by a minority of bad texts. Languages of fewer
  than `least_rows` such texts have no fitted band.

Base counts that hold for any text stand beside them: characters in words, symbols, repeated lines,
repeated three-word windows.

Scale: one pass over the texts; its narrow rows are written, and medians come from histograms of a bounded number
of bins a language. The table of bands is broadcast only if Spark finds its file small enough.

Defined cases: a null or empty text has no words, all its counts are 0, and it fails (fewer than
`min_words` words); repeated rows get equal results, and count as often as they stand; a null doc_id is kept as
it is; the median of an even number of texts is the lower one; an empty table gives an empty result; other
columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.session import ship, written

#: Fixed values. (script, least and most characters per token, most share of byte tokens, least entropy in bits)
BANDS = [
    ("latin", 1.5, 8.0, 0.10, 3.0),
    ("cyrillic", 1.0, 6.0, 0.10, 3.0),
    ("greek", 0.8, 4.0, 0.30, 3.0),
    ("arabic", 0.7, 4.0, 0.40, 3.0),
    ("hebrew", 0.7, 4.0, 0.40, 3.0),
    ("han", 0.4, 3.0, 0.70, 3.0),
    ("kana", 0.4, 3.0, 0.70, 3.0),
    ("hangul", 0.3, 3.0, 0.80, 3.0),
    ("other", 0.2, 8.0, 0.95, 2.0),
]
#: Fixed values. (script, first and last code point of a range of its letters)
RANGES = [
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
]
SYMBOLS = b"#*$%&|<>"
SCRIPTS = [x[0] for x in BANDS]
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string, language string"


def _table(allowed: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(allowed)] = True
    return out


def per_text(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[begin]


def repeats_before(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, several): whether the same (owner, key) stood before; whether it stands at two places or more."""
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    later, several = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    return later, several


def _scripts(w: K.Words) -> np.ndarray:
    """The script of most letters of each text, as a place in SCRIPTS; letters of no known range count as other,
    punctuation, symbols and private-use code points don't count."""
    d = w.data
    n = len(w.first) - 1
    lead = (d & 0xC0) != 0x80
    points = d.astype(np.int32)
    pad = np.concatenate([points, np.zeros(3, np.int32)])
    one, two, three = pad[1 : len(d) + 1] & 0x3F, pad[2 : len(d) + 2] & 0x3F, pad[3 : len(d) + 3] & 0x3F
    points = np.where(d >= 0xF0, (points & 7) << 18 | one << 12 | two << 6 | three, np.where(d >= 0xE0, (points & 15) << 12 | one << 6 | two, np.where(d >= 0xC0, (points & 31) << 6 | one, points)))
    votes = np.zeros((len(SCRIPTS), n), dtype=np.int64)
    known = np.zeros(len(d), dtype=bool)
    for script, a, b in RANGES:
        hit = lead & (points >= a) & (points <= b)
        known |= hit
        votes[SCRIPTS.index(script)] += per_text(hit, w.text_begin, w.text_end)
    letters = (points >= 0x250) & ~((points >= 0x2000) & (points < 0x2C00)) & ~((points >= 0xE000) & (points < 0xF900)) & (points < 0x1F000)
    votes[-1] += per_text(lead & ~known & letters, w.text_begin, w.text_end)
    best = votes.argmax(axis=0)
    best[votes.max(axis=0) == 0] = 0
    return best


def _measure(texts: pa.Array, vocabulary: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    from tessaline.llm.tokens import cache, encoder

    words_of, byte_id = cache(vocabulary), _byte_ids(vocabulary, encoder)
    newline = _table(b"\n")
    for a, b, w in K.of_array(texts):
        n = b - a
        owner = w.text_of_word()
        counts = w.counts()
        prints = w.fingerprints()
        inside = np.zeros(len(w.data) + 1, dtype=np.int8)
        inside[w.begin], inside[w.end] = 1, -1
        lead = ((w.data & 0xC0) != 0x80) & np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        chars = per_text(lead, w.text_begin, w.text_end)
        symbols = per_text(_table(SYMBOLS)[w.data], w.text_begin, w.text_end)

        lines = K.Words(w.data, w.text_begin, w.text_end, *_lines(w, newline))
        line_owner = lines.text_of_word()
        has_word = np.searchsorted(w.begin, lines.end) > np.searchsorted(w.begin, lines.begin)
        later, _ = repeats_before(lines.fingerprints()[has_word], line_owner[has_word])
        dup_lines = np.bincount(line_owner[has_word][later], minlength=n)

        starts = K.window_starts(w.first, 3)
        windows = K.window_fingerprints(prints, 3)[starts[: max(0, len(starts) - 2)]]
        place = np.flatnonzero(starts)
        _, several = repeats_before(windows, owner[place])
        covered = np.zeros(len(prints) + 3, dtype=bool)
        for k in range(3):
            covered[place[several] + k] = True
        repeat_words = np.bincount(owner[covered[: len(prints)]], minlength=n)

        ids, sizes = words_of.of(w)
        token_owner = np.repeat(owner, sizes)
        tokens = np.bincount(token_owner, minlength=n)
        fallback = np.bincount(token_owner[byte_id[ids]], minlength=n)
        pair = np.sort(token_owner.astype(np.int64) << 32 | ids)
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pair))).astype(np.float64)
        whose = (pair[new] >> 32).astype(np.int64)
        weight = np.bincount(whose, weights=times * np.log2(times), minlength=n) if len(new) else np.zeros(n)
        some = np.maximum(tokens, 1)
        yield a, {
            "n_words": counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "n_tokens": tokens,
            "chars_per_token": chars / some, "byte_share": fallback / some, "entropy": np.where(tokens > 0, np.log2(some) - weight / some, 0.0), "script": _scripts(w),
        }


def _lines(w: K.Words, newline: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = newline[w.data]
    ends = np.union1d(np.flatnonzero(cut), w.text_end)
    begins = np.concatenate(([0], ends[:-1] + 1))
    first = np.searchsorted(begins, np.append(w.text_begin, w.text_end[-1] + 1 if len(w.text_end) else 0))
    return begins, ends, first


def _byte_ids(vocabulary: str, encoder) -> np.ndarray:
    key = ("bytes", vocabulary)
    if key not in _BYTES:
        import sentencepiece

        from tessaline.llm.tokens import vocabulary as find

        path = find(vocabulary)
        if not path.endswith(".model"):
            raise ValueError("byte fall-back needs a sentencepiece vocabulary")
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        _BYTES[key] = np.array([p.is_byte(i) or p.is_unknown(i) for i in range(p.get_piece_size())])
    return _BYTES[key]


_BYTES: dict[tuple[str, str], np.ndarray] = {}


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", lang_col: str = "lang") -> DataFrame:
    """Counts and fertility of each row; see OUT. One pass, nothing is shuffled."""
    ship(docs.sparkSession)
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessaline.llm.tokens import cache

        for batch in batches:
            for a, x in _measure(batch.column("text"), vocabulary):
                n = len(x["n_words"])
                cols = {k: pa.array(v, pa.float64() if k in ("chars_per_token", "byte_share", "entropy") else pa.int64()) for k, v in x.items() if k != "script"}
                script = pa.array([SCRIPTS[i] for i in x["script"]], pa.string())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, n), **cols, "script": script, "language": pc.coalesce(batch.column("lang").slice(a, n), script)})
        cache(vocabulary).clear()
        K.release()

    return rows.mapInArrow(run, OUT)


def _medians(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """language, name, n: the lower median of the values of each language, to a thousandth, from a histogram."""
    bins = rows.groupBy("language", F.round(value * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("language").orderBy("bin"))
    bins = bins.withColumn("so_far", so_far).withColumn("all", F.sum("n").over(Window.partitionBy("language")))
    return bins.where(2 * F.col("so_far") >= F.col("all")).groupBy("language").agg((F.min("bin") / 1000).alias(name), F.first("all").alias("n"))


def _off(centre: Column) -> Column:
    return (F.col("chars_per_token") / centre - 1) * F.sqrt("n_tokens")


def fitted_bands(measured: DataFrame, least_rows: int = 100) -> DataFrame:
    """language, centre, spread: the fitted band of each language with `least_rows` measured rows or more."""
    rows = measured.where("n_tokens > 0 and chars_per_token > 0")
    centre = written(_medians(rows, F.col("chars_per_token"), "centre").where(F.col("n") >= least_rows).select("language", "centre"), "centres")
    spread = _medians(rows.join(centre, "language"), F.abs(_off(F.col("centre"))), "spread").select("language", "spread")
    return written(centre.join(spread, "language").select("language", "centre", (1.4826 * F.col("spread")).alias("spread")), "bands")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", min_words: int = 50, max_repeat_percent: int = 50, bands: list[tuple[str, float, float, float, float]] | None = None,
    lang_col: str = "lang", reach: float = 4.5, slack: float = 0.03, least_rows: int = 100,
) -> DataFrame:
    """The measures of each row, base_failed, kept, and the reason it isn't kept for."""
    m = measures(docs, id_col, text_col, vocabulary, lang_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    m = written(m.withColumn("base_failed", failed), "measures")
    m = m.join(fitted_bands(m.where("not base_failed"), least_rows), "language", "left")
    outside = F.lit(None).cast("string")
    for script, low, high, share, bits in bands or BANDS:
        why = (
            F.when(F.col("chars_per_token") < low, "few characters per token")
            .when(F.col("chars_per_token") > high, "many characters per token")
            .when(F.col("byte_share") > share, "byte fall-back")
            .when(F.col("entropy") < bits, "token entropy")
        )
        outside = F.when(F.col("script") == script, why).otherwise(outside)
    off = _off(F.col("centre"))
    far = (F.abs(off) > reach * F.col("spread")) & (F.abs(F.col("chars_per_token") / F.col("centre") - 1) >= slack)
    unlike = F.when(far & (off < 0), "few characters per token for its language").when(far, "many characters per token for its language")
    columns = [x.split()[0] for x in OUT.split(", ")]
    out = m.select(*columns, "base_failed", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(outside, unlike)).alias("reason"))
    return out.withColumn("kept", F.col("reason").isNull())
