"""Language ID by cross-parsing: suffix automata of labelled text, fewest normalised phrases.

For each language a suffix automaton is built of a bounded sample of labelled
text.  A text is parsed against each automaton into phrases, each the longest
match that starts where the last one ended.  The fewer phrases, the better the
language predicts the text: phrases times log2 of the sample's length, over
the text's length, estimates the cross entropy in bits a character.  The
language with the least estimate wins.

Texts are parsed whole, in blocks of BLOCK characters that are each parsed
anew, so that one numpy step advances every block of a batch in every language.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import SLICE, among_least, materialise, text_map

#: Bounds of the sample: documents a language, characters of each, characters a language.
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS = 200, 2_000, 24_000
#: Letters that are told apart: the commonest of each language in turn, up to so many in all; others by so many classes of code points.
LETTERS, CLASSES = 180, 64
BLOCK = 1_024
#: Labels up to which their counts are broadcast (under 100 bytes each).
BROADCAST_LABELS = 100_000
UNDETERMINED = "und"
#: Symbols besides letters: digits, all else, padding; then the classes of other letters.
_DIGIT, _SPACE, _PAD, _CLASS = range(4)


def _script(ch: str) -> str:
    """The first word of a letter's name: LATIN, CJK, HANGUL, ..."""
    return unicodedata.name(ch, "").partition(" ")[0]


class Alphabet:
    """Maps every character to one of at most 250 symbols, letters without regard to case.

    Letters that aren't common in any sample fall into classes by script and
    code point, so that scripts with more letters than symbols are told apart too.
    """

    def __init__(self, samples: list[str]):
        ranked = []
        for sample in samples:
            counts = Counter(ch for ch in sample.lower() if ch.isalpha())
            ranked.append(sorted(counts, key=lambda c: (-counts[c], c)))
        turns = itertools.chain.from_iterable(itertools.zip_longest(*ranked))
        common = list(dict.fromkeys(c for c in turns if c))
        # scripts whose letters don't all have a symbol share the classes; all other letters are one symbol
        rest = sorted({_script(c) for c in common[LETTERS:]})[: CLASSES - 1]
        each = (CLASSES - 1) // len(rest) if rest else 0
        first = {script: _CLASS + 1 + i * each for i, script in enumerate(rest)}
        base = _CLASS + 1 + len(rest) * each
        self.letters = {c: base + i for i, c in enumerate(common[:LETTERS])}
        self.size = base + len(self.letters)
        self.table = np.full(sys.maxunicode + 1, _SPACE, np.uint8)
        for code in range(sys.maxunicode + 1):
            ch = chr(code)
            if ch.isalpha():
                own = self.letters.get(ch.lower())
                if own is None:
                    own = first[script] + code % each if first and (script := _script(ch)) in first else _CLASS
                self.table[code] = own
            elif ch.isdigit():
                self.table[code] = _DIGIT

    def symbols(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root, and the paths from it are the substrings."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def step_table(symbols: list[int], size: int) -> np.ndarray:
    """[state, symbol] -> 2 * next state + 1 if a phrase ends before the symbol.

    A symbol the sample lacks is a phrase of its own: it leads to a last state
    that nothing follows.  The padding symbol stays where it is.
    """
    nxt = suffix_automaton(symbols)
    root = np.full(size, len(nxt), np.int32)
    for c, to in nxt[0].items():
        root[c] = to
    table = np.tile(2 * root + 1, (len(nxt) + 1, 1))
    table[0] = 2 * root
    for state, out in enumerate(nxt):
        for c, to in out.items():
            table[state, c] = 2 * to
    table[:, _PAD] = 2 * np.arange(len(table), dtype=np.int32)
    return table


class Model:
    """Languages, their step tables one under another, and their samples' lengths."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(k for k, v in samples.items() if v)
        self.alphabet = Alphabet([samples[k] for k in self.languages])
        tables, self.roots, base = [], [], 0
        for k in self.languages:
            t = step_table(self.alphabet.symbols(samples[k]).tolist(), self.alphabet.size)
            tables.append(t + 2 * base)
            self.roots.append(base)
            base += len(t)
        self.steps = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.weights = np.array([np.log2(len(samples[k]) + 1) for k in self.languages])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        n = len(self.languages)
        counts = np.zeros((len(texts), n), np.int64)
        owners, blocks = [], []
        for i, text in enumerate(texts):
            s = self.alphabet.symbols(text)
            for at in range(0, len(s), BLOCK):
                owners.append(i)
                blocks.append(s[at : at + BLOCK])
            if len(blocks) >= 4096:
                self._parse(owners, blocks, counts)
                owners, blocks = [], []
        if blocks:
            self._parse(owners, blocks, counts)
        return counts

    def _parse(self, owners: list[int], blocks: list[np.ndarray], counts: np.ndarray) -> None:
        lengths = np.fromiter(map(len, blocks), np.int64, len(blocks))
        order = np.argsort(-lengths, kind="stable")
        grid = np.full((int(lengths.max()), len(blocks)), _PAD, np.uint8)
        for column, i in enumerate(order.tolist()):
            grid[: lengths[i], column] = blocks[i]
        live = np.searchsorted(-lengths[order], -np.arange(len(grid)), side="left")
        size = np.int32(self.alphabet.size)
        found = np.ones((len(self.languages), len(blocks)), np.int64)
        for k, root in enumerate(self.roots):
            state = np.full(len(blocks), root, np.int32)
            ended = np.zeros(len(blocks), np.int32)
            for t, m in enumerate(live.tolist()):
                step = self.steps.take(state[:m] * size + grid[t, :m])
                ended[:m] += step & 1
                np.right_shift(step, 1, out=state[:m])
            found[k] += ended
        np.add.at(counts, np.array(owners)[order], found.T)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text.

        Score: the runner-up's share of the two least estimates, from 0.5 (a
        tie; the language first in the alphabet wins) to 1 (no other language
        learned).  ``und`` with score 0: no letter in the text, null, or no
        language learned.
        """
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        kept = [t for t, has in zip(texts, lettered) if has]
        if not self.languages or not kept:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cost = self.phrases(kept) * self.weights
        best = cost.argmin(axis=1)
        ranked = np.sort(cost, axis=1)
        score = ranked[:, 1] / (ranked[:, 0] + ranked[:, 1]) if ranked.shape[1] > 1 else np.ones(len(kept))
        found = iter(zip(best.tolist(), score.tolist()))
        both = [(self.languages[b], float(s)) if has else (UNDETERMINED, 0.0) for has in lettered for b, s in ([next(found)] if has else [(0, 0.0)])]
        return [x for x, _ in both], [x for _, x in both]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", learn_from: Column | None = None) -> Model:
    """A model of a bounded sample: for each label the SAMPLE_DOCS documents of least hashed id.

    ``learn_from`` says which rows may be learned from.  Rows without label,
    id or letters aren't.  At most SAMPLE_DOCS ids a label go to the driver, and
    of each document SAMPLE_DOC_CHARS characters.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"), F.col(text_col).cast("string").alias("text"))
    if learn_from is not None:
        rows = docs.filter(learn_from).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("label is not null and doc_id is not null")
    h = F.xxhash64("doc_id")
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    sizes = materialise(rows.groupBy("label").agg(F.count("*").alias("n")))
    if sizes.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sizes = F.broadcast(sizes)
    few = rows.select("label", "doc_id", h.alias("h")).join(sizes, "label").filter(among_least(F.col("h"), F.col("n"), SAMPLE_DOCS))
    ids = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_DOCS).select("doc_id").distinct()
    wanted = [r.doc_id for r in ids.collect()]
    if not wanted:
        return Model({})
    taken = rows.filter(F.col("doc_id").isin(wanted)).select("label", "doc_id", h.alias("h"), F.substring("text", 1, SAMPLE_DOC_CHARS).alias("text"))
    taken = taken.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id", "text"))).filter(F.col("r") <= SAMPLE_DOCS)
    samples: dict[str, str] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.label, r.r)):
        if r.text and any(map(str.isalpha, r.text)):
            samples[r.label] = f"{samples.get(r.label, '')}{r.text}\n"[:SAMPLE_CHARS]
    return Model(samples)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, *carry) for each row; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lang, score = sent.value.predict(batch.column(1).to_pylist())
                yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *(batch.column(2 + i) for i in range(len(carry)))], names=["doc_id", "lang_pred", "score", *carry])

    return text_map(rows, run, ", ".join(["doc_id long", "lang_pred string", "score double", *(f"`{c}` {types[c]}" for c in carry)]))


def tagged(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the predicted language of each row.

    ``und`` for null and empty texts and those without a letter; an empty table
    gives an empty table, repeated rows come out repeated; ``name`` must be a
    column that ``docs`` doesn't have (``common.fresh`` gives one).
    """
    sent, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                told = sent.value.predict(batch.column(at_text).to_pylist())[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names=[*batch.schema.names, name])

    return text_map(docs, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, learned from the rows that aren't held out.

    Rows with null ids are never learned from.  Repeated rows come out repeated.
    """
    model = learn(docs, id_col, text_col, label_col, ~held_out(id_col))
    return identify(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
