"""Subject areas of documents: weighted subject terms found by a multi-pattern automaton, scored by length and rarity, cut at thresholds."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import sent, store
from .mail import own_paragraphs

_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?:\s|\Z)")
_BLANK = re.compile(r"\n\s*\n")
#: Labelled rows used for fitting at most.
MAX_EXAMPLES = 20_000
#: Part of a paragraph's best score that another subject needs to count in it as well: a paragraph is on a subject, a lone sentence is not.
SHARE = 0.9


class Terms:
    """Terms with a weight for each subject, worked out from labelled texts and kept as an automaton."""

    def __init__(self, examples: list[tuple[str, list[str]]], subjects: list[str], least: float = 0.25, min_texts: int = 3):
        self.subjects = subjects
        number = {s: i for i, s in enumerate(subjects)}
        texts = [([set(_WORD.findall(p.lower())) for p in _BLANK.split(body or "")], [number[s] for s in labels or [] if s in number]) for body, labels in examples]
        share = [[{s: 1 / len(labels) for s in labels} for _ in ps] for ps, labels in texts]
        self.weight: dict[str, np.ndarray] = {}
        for _ in range(3):  # texts on several subjects: each paragraph goes to the one it fits best so far
            count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(subjects)))
            seen: Counter = Counter()
            for (ps, _labels), parts in zip(texts, share):
                for words, part in zip(ps, parts):
                    for w in words:
                        seen[w] += 1
                        for s, x in part.items():
                            count[w][s] += x
            prior = sum(count.values(), np.zeros(len(subjects))) + 1e-9
            prior /= prior.sum()
            self.weight = {}
            for w, c in count.items():
                purity = (c + 0.5 * prior) / (seen[w] + 0.5)
                # a term must be clearly more frequent in a subject than by chance
                v = np.where(purity >= least + prior, np.log2(np.maximum(purity / prior, 1e-9)), 0.0)
                if seen[w] >= min_texts and v.max() > 0:
                    self.weight[w] = v
            for (ps, labels), parts in zip(texts, share):
                if len(labels) > 1:
                    for i, words in enumerate(ps):
                        fit = sum((self.weight[w] for w in words if w in self.weight), np.zeros(len(subjects)))
                        best = max(labels, key=lambda s: fit[s])
                        parts[i] = {best: 1.0} if fit[best] > 0 else parts[i]
        self.terms = sorted(self.weight)
        self.matrix = np.array([self.weight[w] for w in self.terms]).reshape(len(self.terms), len(subjects))
        self.scale = np.ones(len(self.terms))
        self.threshold = np.zeros(len(subjects))
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def find(self, text: str) -> list[int]:
        """Numbers of the terms that stand in ``text`` as whole words, as often as they do."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.terms):
                self._automaton.add_word(t, (len(t), i))
            self._automaton.make_automaton()
        if not self.terms:
            return []
        s = text.lower()
        last = len(s) - 1
        return [i for end, (n, i) in self._automaton.iter(s) if (end == last or not s[end + 1].isalnum()) and (end - n < 0 or not s[end - n].isalnum())]

    def read(self, paragraphs: list[str], sentences: int) -> list[tuple[int, list[int]]]:
        """(words, term numbers) of each paragraph of at least so many sentences."""
        return [(p.count(" ") + p.count("\n") + 1, self.find(p)) for p in paragraphs if len(_SENTENCE.findall(p)) >= sentences]

    def rarity(self, in_texts: dict[int, int], total: int) -> None:
        """Scale of each term by the number of texts of the whole corpus that hold it; 1 on average."""
        idf = np.array([math.log1p((total + 1) / (in_texts.get(i, 0) + 1)) for i in range(len(self.terms))])
        self.scale = idf / idf.mean() if len(idf) else idf

    def scores(self, words: np.ndarray, sizes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Score of each paragraph for each subject: weight times rarity of its terms, per word."""
        out = np.zeros((len(words), len(self.subjects)))
        if len(terms):
            np.add.at(out, np.repeat(np.arange(len(words)), sizes), self.matrix[terms] * self.scale[terms, None])
        return out / np.maximum(words, 1)[:, None]

    def leading(self, words: np.ndarray, sizes: np.ndarray, terms: np.ndarray, share: float) -> np.ndarray:
        """Scores, 0 where they are less than ``share`` of their paragraph's best."""
        score = self.scores(words, sizes, terms)
        return np.where(score >= share * score.max(axis=1, initial=0)[:, None], score, 0)

    def calibrate(self, examples: list[tuple[str, list[str]]], sentences: int, share: float = SHARE) -> None:
        """For every subject the threshold of the best F1 on labelled texts: the geometric middle between the lowest score taken and the next
        lower one, which counts as a tenth of the former at least."""
        best = np.zeros((len(examples), len(self.subjects)))
        truth = np.zeros(best.shape, bool)
        for k, (body, labels) in enumerate(examples):
            found = self.read([p for p in _BLANK.split(body or "") if p.strip()], sentences)
            if found:
                best[k] = self.leading(np.array([n for n, _ in found]), np.array([len(t) for _, t in found]), np.array([x for _, t in found for x in t], int), share).max(axis=0)
            truth[k] = [s in (labels or []) for s in self.subjects]
        for s in range(len(self.subjects)):
            order = np.argsort(-best[:, s], kind="stable")
            score, hit = best[order, s], truth[order, s]
            f1 = 2 * np.cumsum(hit) / (np.arange(1, len(hit) + 1) + max(1, hit.sum())) if len(hit) else np.zeros(0)
            if not hit.any():
                self.threshold[s] = np.inf
                continue
            f1[np.r_[score[:-1] == score[1:], False]] = 0
            at = int(np.argmax(f1))
            below = score[at + 1] if at + 1 < len(score) else 0.0
            self.threshold[s] = max(math.sqrt(score[at] * max(below, score[at] / 10)), 1e-9)


def subjects(documents: DataFrame, examples: DataFrame, areas: DataFrame, doc: str = "doc_id", text: str = "text", body: str = "body", labels: str = "subjects", area: str = "subject", sentences: int = 3, share: float = SHARE, max_examples: int = MAX_EXAMPLES, paragraphs: Callable[[str | None], list[str]] = own_paragraphs) -> DataFrame:
    """(doc, area): every subject area of a document, one for each area that some paragraph of at least ``sentences`` sentences exceeds
    the area's threshold in, with a score of at least ``share`` of the paragraph's best (a lone sentence on something else is none).

    Terms and weights come from labelled examples (at most ``max_examples`` rows, taken in order of a hash), thresholds from the best F1
    on them; every term of theirs and every area is kept, and the driver holds both. How rare a term is, is counted over all documents. ``paragraphs`` gives a document's own paragraphs; each is read whole.
    The corpus is parsed once, its term lists are written to the shared folder; it is never shuffled, save for the term counts.

    Null or empty texts have no subject. Documents with a null id take part, with that id. Repeated documents give a row each. Areas that
    are null or have no example are never assigned. No examples or no documents give no rows. Other columns are ignored.
    """
    names = sorted({r[0] for r in areas.select(F.col(f"`{area}`")).distinct().collect() if r[0] is not None})
    chosen = examples.select(F.col(f"`{body}`").alias("b"), F.col(f"`{labels}`").alias("s")).dropna()
    rows = [(r["b"], list(r["s"])) for r in chosen.orderBy(F.xxhash64("b"), "b").limit(max_examples).collect()]
    model = Terms(rows, names)
    shared = sent(documents.sparkSession, model)
    ints = T.ArrayType(T.IntegerType())
    held = T.StructType([T.StructField(doc, documents.schema[doc].dataType), T.StructField("words", ints), T.StructField("sizes", ints), T.StructField("terms", ints)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        m, schema = shared(), to_arrow_schema(held)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(ids), 1000):
                found = [m.read(paragraphs(t.as_py()), sentences) for t in texts.slice(at, 1000)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), pa.array([[n for n, _ in f] for f in found], schema[1].type), pa.array([[len(t) for _, t in f] for f in found], schema[2].type), pa.array([[x for _, t in f for x in t] for f in found], schema[3].type)], schema=schema)

    parsed = store(documents.select(F.col(f"`{doc}`"), F.col(f"`{text}`")).mapInArrow(read, held), "terms")
    counted = parsed.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().collect()  # as many rows as terms, at most
    model.rarity({r["term"]: r["count"] for r in counted}, parsed.count())
    model.calibrate(rows, sentences, share)
    ready = sent(documents.sparkSession, model)
    out = T.StructType([held[0], T.StructField(area, T.StringType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        m, schema = ready(), to_arrow_schema(out)
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            words, sizes, terms = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
            owner = np.repeat(np.arange(b.num_rows), n)
            p, s = np.nonzero(m.leading(words, sizes, terms, share) > m.threshold)
            pairs = np.unique(owner[p] * len(m.subjects) + s)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs // max(1, len(m.subjects)))), pa.array([m.subjects[i] for i in pairs % max(1, len(m.subjects))], pa.string())], schema=schema)

    return parsed.mapInArrow(assign, out)
