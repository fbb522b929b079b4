"""Language identification by word-first backoff.

Method: a known word scores its log frequency in each language; an unseen word backs off to its longest character
n-grams (four down to one, with word edges marked) of which the model knows any, scored by their mean log frequency.
A document's scores are the sums over its words; the best language wins, and the score is its posterior probability.

Fitting uses at most about `fit_rows` labelled rows (a documented bound; chosen by a hash of the id among rows whose
crc32(id) mod 5 is not 0), and keeps every word and n-gram that they hold, with its counts in all languages: the bound on
the sample is the only one on the model. Words are counted first, and n-grams are made of distinct words. The model is
fetched and sent in Arrow columns and a float32 table; the driver makes no Python object of an entry. Prediction reads
all rows and whole texts, and the text alone: the words of a slice of texts are made distinct in Arrow, each distinct one
is scored once, and a gather and a sum over each text's own words give the documents' scores.

Defined results: null texts and texts without a letter are `und` with score 0. If nothing can be learned (an empty
table or no labels) every row is `und`. Ties go to the alphabetically first language. Repeated rows repeat.
A very long text is scored whole by one task, its distinct words once. An empty table gives no rows; other columns are
not read. A text's score doesn't depend on the rows beside it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_slices, texts_of, tidy

UNDETERMINED = "und"
FIT_ROWS = 20_000
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.1
LETTERS = re.compile(r"[^\W\d_]+")
CACHE_ENTRIES = 200_000
#: Words that are looked up at once.
LEARN_WORDS = 1 << 13


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, word); a partial aggregate of each batch."""
    for batch in batches:
        counted: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            counted[lang].update(LETTERS.findall(text.lower()))
        for lang, words in counted.items():
            columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "c"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, entry) from counted words: the word itself (order 0) and its n-grams; partial aggregates."""
    for batch in batches:
        rows: dict[tuple[str, str], int] = defaultdict(int)
        for lang, word, c in zip(*(column.to_pylist() for column in batch.columns)):
            rows[lang, "0" + word] += c
            for n in ORDERS:
                for g in grams(word, n):
                    rows[lang, f"{n}{g}"] += c
        if rows:
            langs, entries = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(entries, pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "entry", "c"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> dict:
    """The model: languages, the entries, and per entry a log-frequency vector."""
    bound_batches(df.sparkSession)
    usable = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull())
    n = usable.count()
    if n > fit_rows:  # the fitting sample; its bound is fit_rows
        usable = usable.filter(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 40)) < int((1 << 40) * (fit_rows / n)))
    labelled = usable.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words = labelled.mapInArrow(tidy(_words), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    entries = words.mapInArrow(tidy(_entries), "lang string, entry string, c long").groupBy("lang", "entry").agg(F.sum("c").alias("c"))
    return build(entries.toArrow())


def build(rows: pa.Table) -> dict:
    """From columns lang, entry (a digit for the order, then the gram) and c."""
    coded = {c: rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "entry")}
    names = coded["lang"].dictionary.to_pylist()
    langs = sorted(names)
    column = np.array([langs.index(x) for x in names], np.int64)[np.asarray(coded["lang"].indices)]
    entries, at = coded["entry"].dictionary, np.asarray(coded["entry"].indices)
    kinds = np.asarray(pa.compute.utf8_slice_codeunits(entries, 0, 1).cast(pa.int64()))
    table = np.zeros((len(entries), len(langs)), np.float32)
    counts = np.asarray(rows.column("c"))
    totals = np.zeros((max(ORDERS) + 1, len(langs)))
    np.add.at(totals, (kinds[at], column), counts)
    sizes = np.bincount(kinds, minlength=len(totals))
    table[at, column] = counts
    for n in range(len(totals)):
        rows_n = np.flatnonzero(kinds == n)
        table[rows_n] = np.log((table[rows_n].astype(np.float64) + SMOOTHING) / (totals[n] + SMOOTHING * sizes[n]))
    return {"langs": langs, "entries": entries, "logs": table}


class Places:
    """Where strings lie in an Arrow column of distinct ones: sorted hashes, 12 bytes an entry; hits are compared as strings."""

    def __init__(self, entries: pa.Array):
        self.entries, hashes = entries, np.empty(len(entries), np.int64)
        for k in range(0, len(entries), 1 << 14):
            hashes[k : k + (1 << 14)] = [hash(x) for x in entries.slice(k, 1 << 14).to_pylist()]
        order = np.argsort(hashes)
        self.hashes, self.at = hashes[order], order.astype(np.int32)

    def __call__(self, wanted: list[str]) -> np.ndarray:
        """The place of each string, -1 for those that aren't there."""
        out = np.full(len(wanted), -1, np.int64)
        hashes = np.fromiter(map(hash, wanted), np.int64, len(wanted))
        spot, texts = np.searchsorted(self.hashes, hashes), pa.array(wanted, self.entries.type)
        left = np.arange(len(wanted))
        while True:  # again for strings whose hash another entry has too
            left = left[spot[left] < len(self.hashes)]
            left = left[self.hashes[spot[left]] == hashes[left]]
            if not len(left):
                return out
            found = self.at[spot[left]]
            same = np.asarray(pa.compute.equal(texts.take(pa.array(left)), self.entries.take(pa.array(found))))
            out[left[same]] = found[same]
            left = left[~same]
            spot[left] += 1


class Predictor:
    """Scores by words, remembered: each word has a row of scores."""

    def __init__(self, model: dict):
        self.langs, self.logs = model["langs"], model["logs"]
        self.places = Places(model["entries"])
        self.fresh()

    def fresh(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.langs)), np.float32)

    def found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model's entries of each word, one word after the other, and how many each has: its own, or those of its
        longest n-grams of which the model knows any."""
        entries = self.places(["0" + w for w in words])
        word, left = np.flatnonzero(entries >= 0), np.flatnonzero(entries < 0)
        words_of, entries_of = [word], [entries[word]]
        for n in ORDERS:
            made = [[f"{n}{g}" for g in grams(words[i], n)] for i in left.tolist()]
            word = np.repeat(left, np.array([len(x) for x in made], np.int64))
            entries = self.places([g for x in made for g in x])
            words_of.append(word[entries >= 0])
            entries_of.append(entries[entries >= 0])
            left = np.setdiff1d(left, words_of[-1])
        word = np.concatenate(words_of)
        return np.concatenate(entries_of)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """A row for each of the words: the mean over its entries, all in one gather."""
        entries, counts = self.found(words)
        at, need = len(self.rows), len(self.rows) + len(words)
        if need > len(self.table):
            wider = np.zeros((max(need, 2 * len(self.table)), len(self.langs)), np.float32)
            wider[:at] = self.table[:at]
            self.table = wider
        own = np.flatnonzero(counts)
        if len(own):
            starts = (np.cumsum(counts) - counts)[own]
            self.table[at + own] = np.add.reduceat(self.logs[entries], starts, axis=0) / counts[own, None]
        self.rows.update(zip(words, range(at, need)))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The summed word scores of every text, and its number of words."""
        if len(self.rows) > CACHE_ENTRIES:
            self.fresh()
        words, counts = [], []
        for t in texts:
            found = LETTERS.findall(t.lower())
            words += found
            counts.append(len(found))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [x for x in distinct if x not in self.rows]
        for k in range(0, len(fresh), LEARN_WORDS):
            self.learn(fresh[k : k + LEARN_WORDS])
        each = self.table[np.array(list(map(self.rows.__getitem__, distinct)), np.int64)[np.asarray(coded.indices)]] if words else self.table[:0]
        totals, sizes = np.zeros((len(counts), len(self.langs))), np.array(counts, np.int64)
        own = np.flatnonzero(sizes)
        if len(own):
            totals[own] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[own], axis=0, dtype=np.float64)
        return totals, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text; of equal scores the first language's wins."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        total, counts = self.scores(texts)
        total = np.round(total, 6)
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[k] if c else UNDETERMINED for c, k in zip(counts.tolist(), best.tolist())], np.where(counts > 0, sure, 0.0).tolist()


_predictors: dict[str, Predictor] = {}


def predictor(sent, name: str) -> Predictor:
    """The partition's predictor, from the broadcast model."""
    if name not in _predictors:
        _predictors.clear()
        _predictors[name] = Predictor(sent.value)
    return _predictors[name]


def forget_predictors() -> None:
    """Workers outlive their tasks: what follows in them needs no model."""
    _predictors.clear()


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: dict | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. One pass over df's own partitions after fitting."""
    if model is None:
        model = fit(df, id_col, text_col, lang_col)
    sent, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predictor(sent, name).predict(texts_of(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    plain = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    return map_slices(plain, kernel, SCHEMA, last=forget_predictors)


def keep_identified(df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df without the rows whose language stays undetermined or uncertain; a null label takes the prediction."""
    model = fit(df, id_col, text_col, lang_col)
    sent, name = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at, lang_at = df.columns.index(text_col), df.columns.index(lang_col)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predictor(sent, name).predict(texts_of(batch.column(at)))
        columns = list(batch.columns)
        columns[lang_at] = pa.compute.coalesce(columns[lang_at], pa.array(langs, pa.string()).cast(columns[lang_at].type))
        out = pa.RecordBatch.from_arrays(columns, batch.schema.names)
        return out.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return map_slices(df, kernel, df.schema, text_at=at, last=forget_predictors)
