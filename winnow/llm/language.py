"""Language identification by cross-parsing entropy (operator 5).

For each language a suffix automaton of labelled text is built. A text is parsed
into the fewest phrases that occur in the language's text, each the longest match
from where it starts; phrases x log(length of the language's text) over the
length of the text estimates the cross entropy, and the language with the least
wins. Letters are compared without case, and what lies between words as one blank.

The labelled text is a bounded sample, SAMPLE letters and blanks for each
language from whole documents in the order of a hash; the texts to be told are
parsed whole, in runs of RUN symbols, as if each run started a phrase. Every
letter of the samples is told apart, whatever their scripts: transitions are kept
in one row of slots that all states share (`comb`), not in a table of states by
letters.

The score compares the languages' costs: a language that needs x times the cost
of the winner weighs exp(-SHARPNESS (x - 1)), and the score is the winner's share.

Cases: null texts, and texts without letters, get `und` and the score 0. If there
is no labelled text at all, so do all. A letter that doesn't occur in a language's
text ends a phrase there, and the next starts after it. Ties go to the language
that is first by name. An empty table gives an empty result. Null and repeated
doc_ids pass through. Columns beside doc_id, text and, for learning, lang aren't
read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from winnow.llm.shared import ship

UND = "und"
#: Symbols of labelled text for each language, documents they are taken from, and languages, at most.
SAMPLE, DOCUMENTS, LANGUAGES = 60_000, 800, 500
RUN = 512
#: How fast a language's weight falls as its cost exceeds the winner's.
SHARPNESS = 8.0
_CHUNK = 1 << 20
_LOW = (1 << 32) - 1

_letters = None


def letter_table() -> np.ndarray:
    """For each code point: 0 if it is no letter, else the code point of its lower case."""
    global _letters
    if _letters is None:
        table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters = table
    return _letters


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, with one 0 for what is between words and before each text;
    and where each text starts, with the end."""
    codes = np.frombuffer("".join("\0" + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = letter_table()[codes]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    keep[begins[:-1]] = True
    return low[keep], np.append(0, np.cumsum(keep))[begins]


def suffix_automaton(text: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a text: how many states (0 is the start), and its
    transitions as states, symbols and next states."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    at = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
    return len(nexts), at, np.array([c for x in nexts for c in x], dtype=np.int64), np.array([s for x in nexts for s in x.values()], dtype=np.int64)


def comb(states: int, at: np.ndarray, symbol: np.ndarray, alphabet: int) -> tuple[np.ndarray, int]:
    """Places for transitions (at, symbol, in order of at) in one row of slots: a
    base for each state, so that no two transitions have the same base + symbol;
    and how many slots that takes, so that any base + symbol is one.

    States with the most transitions come first, each at the first base, from a
    little before the last, that is free for all of them; those with one alone
    fill what is left.
    """
    degree = np.bincount(at, minlength=states)
    first = np.append(0, np.cumsum(degree))
    base = np.zeros(states, dtype=np.int64)
    used = np.zeros(4 * len(at) + 4 * alphabet + 4096, dtype=bool)
    last = 0
    for s in np.argsort(-degree, kind="stable"):
        if degree[s] < 2:
            break
        own = symbol[first[s] : first[s + 1]]
        b = max(0, last - 1024)
        while True:
            if b + 512 + alphabet > len(used):
                used = np.append(used, np.zeros(len(used), dtype=bool))
            taken = used[b + own[0] : b + own[0] + 512].copy()
            for c in own[1:]:
                taken |= used[b + c : b + c + 512]
            k = int(taken.argmin())
            if not taken[k]:
                break
            b += 512
        base[s] = last = b + k
        used[b + k + own] = True
    single = np.flatnonzero(degree == 1)
    used = np.append(used, np.zeros(alphabet + len(single), dtype=bool))
    slots = alphabet + np.flatnonzero(~used[alphabet:])[: len(single)]
    base[single] = slots - symbol[first[single]]
    used[slots] = True
    return base, int(base.max(initial=0)) + alphabet


class Parser:
    """Counts the phrases of texts for each language of a model (name -> labelled text)."""

    def __init__(self, model: dict[str, str], sample: int = SAMPLE):
        self.names = sorted(model)
        texts = [folded([model[n]])[0][:sample] for n in self.names]
        self._known = np.unique(np.concatenate([np.zeros(1, dtype=np.uint32), *texts]))[1:]
        alphabet = len(self._known) + 2
        owner, target, again, self._starts, states, slots = [], [], [], [], 0, 0
        for text in texts:
            n, at, symbol, to = suffix_automaton(self._symbols(text))
            base, size = comb(n, at, symbol, alphabet)
            # a state is its number and its base in one number
            packed = (np.arange(n) + states << 32) + base + slots
            own, into = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int64)
            own[base[at] + symbol] = at + states
            into[base[at] + symbol] = packed[to]
            # a symbol that doesn't continue a phrase ends it, and starts the next
            starts = np.full(alphabet, packed[0])
            starts[symbol[at == 0]] = packed[to[at == 0]]
            owner.append(own)
            target.append(into)
            again.append(starts)
            self._starts.append(packed[0])
            states, slots = states + n, slots + size
        self._owner = np.concatenate([np.zeros(0, dtype=np.int32), *owner])
        self._target = np.concatenate([np.zeros(0, dtype=np.int64), *target])
        self._again = np.array(again, dtype=np.int64).reshape(len(again), alphabet)
        self._cost = np.array([np.log(max(len(t), 2)) for t in texts])

    def _symbols(self, letters: np.ndarray) -> np.ndarray:
        """0 for a blank, 1 for a letter that no sample has, and from 2 the samples' letters."""
        place = np.searchsorted(self._known, letters)
        known = self._known[np.minimum(place, len(self._known) - 1)] == letters if len(self._known) else np.zeros(len(letters), dtype=bool)
        return np.where(known, place + 2, letters != 0).astype(np.int64)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) in each language, and the symbols of each text."""
        low, bounds = folded(texts)
        symbols = self._symbols(low)
        lengths = np.diff(bounds)
        runs = np.maximum(1, -(-lengths // RUN))
        owner = np.repeat(np.arange(len(texts)), runs)
        begins = bounds[owner] + RUN * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
        size = np.minimum(RUN, bounds[owner + 1] - begins)
        order = np.argsort(-size, kind="stable")
        begins, size, owner = begins[order], size[order], owner[order]
        state = np.repeat(np.array(self._starts, dtype=np.int64)[:, None], len(owner), axis=1)
        count = np.ones(state.shape, dtype=np.int32)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, m in enumerate(live.tolist()):
            now, symbol = state[:, :m], symbols[begins[:m] + t]
            slot = (now & _LOW) + symbol
            goes = self._owner.take(slot) == now >> 32
            count[:, :m] += ~goes
            state[:, :m] = np.where(goes, self._target.take(slot), self._again.take(symbol, axis=1))
        out = np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], axis=1) if len(count) else np.zeros((len(texts), 0))
        return out, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how sure that is (0 to 1)."""
        whole = [t or "" for t in texts]
        counts, lengths = self.phrases(whole)
        if not self.names:
            return [UND] * len(texts), np.zeros(len(texts))
        cost = counts * self._cost
        best = cost.argmin(axis=1)
        least = cost.min(axis=1, keepdims=True)
        score = 1 / np.exp(-SHARPNESS * (cost / least - 1)).sum(axis=1)
        none = lengths < 2  # the blank before a text, and nothing else but blanks
        return [UND if n else self.names[b] for n, b in zip(none, best, strict=True)], np.where(none, 0.0, score)


def learn(labelled: DataFrame, sample: int = SAMPLE, documents: int = DOCUMENTS, languages: int = LANGUAGES) -> dict[str, str]:
    """Labelled text for each language, from rows with doc_id, text and lang that is not null.

    As many whole documents as give `sample` symbols, in the order of a hash of
    their texts, at most `documents` for each language; the `languages` that have most
    rows are learnt, and others are never told.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    # ties in number go by name, so that reruns learn the same languages
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    times = {r["lang"]: r["n"] for r in most.collect()}
    if not times:
        return {}
    # a share of each language's rows that holds twice as many documents as are asked for
    share = F.create_map(*[F.lit(x) for k, n in sorted(times.items()) for x in (k, min(1.0, 2 * documents / n))])
    draw = F.pmod(F.xxhash64("text", F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).dropDuplicates(["lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    out: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    # one row at a time: only as much is kept as the bound allows
    for r in drawn.withColumn("place", place).where(F.col("place") <= documents).orderBy("lang", "place").toLocalIterator():
        if used.get(r["lang"], 0) < sample:
            n = len(folded([r["text"]])[0]) - 1
            if n > 1:
                out.setdefault(r["lang"], []).append(r["text"])
                used[r["lang"]] = used.get(r["lang"], 0) + n
    return {k: " ".join(v) for k, v in out.items()}


def identify(docs: DataFrame, model: dict[str, str], sample: int = SAMPLE, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, the language of each text and how sure that is."""
    ship(docs.sparkSession)
    parser, at_text = Parser(model, sample), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            sizes = batch.column(at_text).fill_null("").cast(pa.large_string())
            ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + batch.num_rows + 1] if batch.num_rows else np.zeros(1, dtype=np.int64)
            at = 0
            while at < batch.num_rows:  # about a chunk of text at a time
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + _CHUNK, side="right")) - 1))
                n, s = parser.predict(batch.column(at_text).slice(at, to - at).to_pylist())
                names += n
                scores.append(s)
                at = to
            more = [pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, pred, score])

    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out_id(folds: int = 5):
    """Whether a document's doc_id falls in the fold that nothing is learnt from; a null id does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def predict_languages(docs: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learnt from the documents outside the held-out fold."""
    model = learn(docs.where(~held_out_id(folds)), sample)
    return identify(docs.select("doc_id", "text"), model, sample).select("doc_id", held_out_id(folds).alias("held_out"), "lang_pred", "score")
