"""Language ID by cross-parsing: the language whose text parses a document into the fewest phrases wins.

For each language a suffix automaton of labelled text is built. A document is parsed greedily: every phrase is the
longest match that the automaton gives from where the last phrase ended, plus the character that broke it. The count of
phrases estimates the cross entropy with that language. Thousands of lanes of LANE characters are parsed in lock step over
numpy transition tables. A lane first begins at a phrase's begin; where the lane before it ends inside a phrase, it is parsed
again from that state until a phrase ends where one of the first parse did. So phrases run across lanes, and the count is
that of the whole text.

An automaton knows every character of its language's sample; any other breaks a phrase. Tables are dense where states times
characters are few, otherwise the transitions are searched for, with equal results.
Texts are lower-cased; runs without letters (as str.isalpha has them) become one space. Training takes whole texts of at most
`symbols` / 2 characters: per language the rows of smallest hash in each of `rows` hash slots, until `symbols` characters
are reached (both are the documented bounds of the labelled sample; a language that has only longer texts is not learned).
Null texts and texts without letters are `und` with score 0; ties go to the alphabetically first language; if no label
can be learned every row is `und`. Every row gives one row, repeated ones and ones of a null id too; other columns are
dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import chunks, tidy

ROWS = 200
SYMBOLS = 24_000
LANE = 256
DENSE = 8 << 20  # entries of a dense transition table
END = 0xFFFF
_NOT_LETTERS = regex.compile(r"\P{L}+")


def normalise(text: str | None) -> str:
    text = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {text} " if text else ""


class Automaton:
    """Suffix automaton over small integer symbols: `step` gives the state after (state, symbol), 0 if there is none.

    State 1 is the root. Symbol 0 (a character that the language's sample lacks) never matches.
    """

    def __init__(self, codes: np.ndarray, dense: int = DENSE):
        step: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in codes.tolist():
            cur = len(step)
            step.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if not p:
                link[cur] = 1
            elif length[p] + 1 == length[q := step[p][c]]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
            last = cur
        self.width = int(codes.max(initial=0)) + 1
        keys = np.array([s * self.width + c for s, out in enumerate(step) for c in out], np.int64)
        made = np.array([t for out in step for t in out.values()], np.int32)
        if len(step) * self.width <= dense:
            self.table = np.zeros(len(step) * self.width, np.uint16 if len(step) < 65536 else np.int32)
            self.table[keys] = made
        else:
            self.table = None
            order = np.argsort(keys)
            self.keys, self.made = keys[order], made[order]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + symbol
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], 0)


class Profiles:
    def __init__(self, texts: dict[str, str], dense: int = DENSE):
        self.langs = sorted(texts)
        self.points = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le"), np.uint32))[: END - 2]
        self.automata, self.maps = [], []
        for lang in self.langs:
            codes = self.encode(texts[lang])
            own = np.unique(codes[codes > 0])
            local = np.zeros(len(self.points) + 2, np.uint16)
            local[own] = np.arange(1, len(own) + 1)
            self.maps.append(local)
            self.automata.append(Automaton(local[codes], dense))

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.points, raw), len(self.points) - 1)
        return np.where(self.points[at] == raw, at + 1, 0).astype(np.uint16)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of every text by every language's automaton."""
        coded = [self.encode(t) for t in texts]
        lanes = np.array([-(-len(c) // LANE) for c in coded])
        grid = np.zeros((int(lanes.sum()), LANE), np.uint16)
        row = 0
        for c, n in zip(coded, lanes.tolist(), strict=True):
            grid[row : row + n].reshape(-1)[: len(c)] = c
            row += n
        last = np.cumsum(lanes) - 1  # lane that ends each text
        size = np.full(len(grid), LANE)
        size[last] = [len(c) - LANE * (n - 1) for c, n in zip(coded, lanes.tolist(), strict=True)]
        owner = np.repeat(np.arange(len(texts)), lanes)
        follows = np.append(False, owner[1:] == owner[:-1])
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(LANE), "left")
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, automaton in enumerate(self.automata):
            columns = np.ascontiguousarray(self.maps[k][grid][order].T)
            state = np.ones(len(order), np.int32)
            breaks = np.zeros((LANE, len(order)), bool)
            for j in range(LANE):
                n = live[j]
                if not n:
                    break
                nxt = automaton.step(state[:n], columns[j, :n])
                breaks[j, :n] = nxt == 0
                state[:n] = np.where(nxt == 0, 1, nxt)
            end, found = np.empty_like(state), np.empty((len(order), LANE), bool)
            end[order], found[order] = state, breaks.T
            self._join(automaton, self.maps[k], grid, size, follows, end, found)
            count = found.sum(1)
            count[last] += end[last] != 1  # the phrase that the text's end closes
            out[:, k] = np.bincount(owner, count, len(texts))
        return out

    @staticmethod
    def _join(automaton: Automaton, local: np.ndarray, grid: np.ndarray, size: np.ndarray, follows: np.ndarray, end: np.ndarray, found: np.ndarray) -> None:
        """Parse lanes again from the state in which the lane before ends, until nothing moves; end and found are updated."""
        begun = np.ones(len(end), np.int32)
        while True:
            before = np.append(1, end[:-1])
            again = np.flatnonzero(follows & (before != begun))
            if not len(again):
                return
            begun[again] = before[again]
            state, at = begun[again].copy(), again
            for j in range(LANE):
                nxt = automaton.step(state, local[grid[at, j]])
                broke = nxt == 0
                met = broke & found[at, j]  # from here on both parses are the same
                found[at, j] = broke
                state = np.where(broke, 1, nxt)
                over = (size[at] == j + 1) & ~met
                end[at[over]] = state[over]
                on = ~met & ~over
                at, state = at[on], state[on]
                if not len(at):
                    break


def train(labelled: DataFrame, rows: int = ROWS, symbols: int = SYMBOLS) -> Profiles | None:
    """Profiles from (text, lang): whole texts of the bounded sample described above. The labels' number is small."""
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= symbols // 2))
    # min_by keeps the `rows` least hashes while it aggregates, so a language that most rows share is not gathered.
    slots = known.withColumn("h", F.xxhash64("text")).withColumn("slot", F.pmod(F.shiftright("h", 8), F.lit(rows)))
    top = slots.groupBy("lang", "slot").agg(F.min_by("text", "h").alias("text"), F.min("h").alias("h"))
    texts: dict[str, str] = {}
    for row in top.orderBy("lang", "h").collect():
        if len(texts.get(row.lang, "")) < symbols:
            texts[row.lang] = texts.get(row.lang, "") + normalise(row.text)
    texts = {lang: t for lang, t in texts.items() if t.strip()}
    return Profiles(texts) if texts else None


def identify(docs: DataFrame, profiles: Profiles | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row; score is the share of the runner-up in the best two's phrases (1 if
    only one language is known), so 0.5 means a tie."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        profiles = held.value
        for batch in chunks(batches, "text"):
            texts = [normalise(t) for t in batch.column("text").to_pylist()]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if t]
            if profiles and some:
                table = profiles.phrases([texts[i] for i in some])
                best = table.argmin(1)
                two = np.sort(table, 1)[:, :2] if table.shape[1] > 1 else None
                for r, i in enumerate(some):
                    langs[i] = profiles.langs[best[r]]
                    scores[i] = float(two[r, 1] / (two[r, 0] + two[r, 1])) if two is not None else 1.0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(tidy(run), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
