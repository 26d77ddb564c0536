"""Language ID by hierarchical discrimination: the family first, then the language within it.

Linear support vector machines over hashed character 1- to 3-grams decide both: one-versus-one between families, then
one-versus-one between the languages of the winning family. Votes decide, then summed margins, then the name.

Training takes a bounded sample: of each language about `ROWS_PER_LANGUAGE` labelled rows, chosen by a hash of the id
(all rows if a language has fewer), of `MAX_LANGUAGES` languages at most. Their features are computed on the executors and arrive sparse at the driver,
where the machines are solved by dual coordinate descent. Prediction maps over all rows and reads whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxelake.llm.common import tune

#: Labelled rows of each language that training sees, in expectation; twice that for all together at most.
ROWS_PER_LANGUAGE = 300
#: Languages that are learned at most: those with the most labelled rows, ties by name.
MAX_LANGUAGES = 200
#: Least score of a text whose language `keep_identified` takes as told. The machines of a real text's language and
#: family rarely agree so little: of the 10,000 documents of the 0.1 tables the least score is 0.29.
MIN_SCORE = 0.2
#: Hash bins of the 1-, 2- and 3-grams.
BINS = (256, 2048, 4096)
#: Code points of a text whose grams are counted at a time; bounds memory, not the text.
CHUNK = 1 << 20
#: Families of languages. One that stands in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), f"only {lang}")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letter_table() -> np.ndarray:
    """For each code point of the basic plane itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


def features(text: str, letters: np.ndarray) -> np.ndarray:
    """Square roots of hashed gram counts, each order scaled to length one."""
    totals = [np.zeros(b) for b in BINS]
    for at in range(0, max(1, len(text)), CHUNK):
        points = np.frombuffer(text[max(0, at - 2) : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = letters[np.minimum(points, 0xFFFF)]
        grams = c * np.uint32(2654435761)
        totals[0] += np.bincount(grams >> np.uint32(24), minlength=BINS[0])
        if len(c) > 1:
            two = (grams[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
            totals[1] += np.bincount(two >> np.uint32(21), minlength=BINS[1])
        if len(c) > 2:
            three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
            totals[2] += np.bincount(three >> np.uint32(20), minlength=BINS[2])
    return np.concatenate([np.sqrt(t / max(t.sum(), 1)) for t in totals]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last one the bias) of an L2-regularised squared-hinge machine, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weights, alpha, order = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.random.default_rng(7)
    square = (x * x).sum(1) + 0.5 / cost
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * float(weights @ x[i]) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                weights += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def pairwise(x: np.ndarray, names: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    """One machine for each pair of names; positive margins speak for the first."""
    out = {}
    for a, b in combinations(sorted(set(names)), 2):
        rows = (names == a) | (names == b)
        out[a, b] = svm(x[rows], np.where(names[rows] == a, 1.0, -1.0))
    return out


def decide(x: np.ndarray, candidates: list[str], machines: dict[tuple[str, str], np.ndarray]) -> tuple[str, float]:
    """(winner, its weakest pairwise probability) by votes, then margins, then name."""
    votes, margins, least = dict.fromkeys(candidates, 0), dict.fromkeys(candidates, 0.0), {c: 1.0 for c in candidates}
    for a, b in combinations(sorted(candidates), 2):
        w = machines[a, b]
        margin = float(w[:-1] @ x) + float(w[-1])
        votes[a if margin > 0 else b] += 1
        for name, m in ((a, margin), (b, -margin)):
            margins[name] += m
            least[name] = min(least[name], 1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * m)))))
    best = min(candidates, key=lambda c: (-votes[c], -margins[c], c))
    return best, least[best]


@dataclass
class LanguageModel:
    """The fitted hierarchy: family -> its learned languages, and the machines of both levels."""

    families: dict[str, list[str]] = field(default_factory=dict)
    family_machines: dict = field(default_factory=dict)
    language_machines: dict = field(default_factory=dict)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return "und", 0.0
        x = features(text, letters)
        family, sure = decide(x, list(self.families), self.family_machines)
        lang, surer = decide(x, self.families[family], self.language_machines)
        return lang, sure * surer


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel:
    if not langs:
        return LanguageModel()
    named = np.array(langs, object)
    of = np.array([family_of(lang) for lang in langs], object)
    families = {f: sorted(set(named[of == f])) for f in sorted(set(of))}
    within = {}
    for f in families:
        within |= pairwise(x[of == f], named[of == f])
    return LanguageModel(families, pairwise(x, of), within)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the rows that have a label and a letter in their text."""
    tune(rows.sparkSession)
    labelled = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = labelled.groupBy(F.col(lang_col).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    counts = {r[0]: r[1] for r in labels.limit(MAX_LANGUAGES).collect()}
    if not counts:
        return LanguageModel()
    # a share of each language by a hash of the id, so the sample needs no shuffle and reruns agree
    draw, keep = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1_000_000)), F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col(lang_col) == lang) & (draw < min(1_000_000, math.ceil(1_000_000 * rows_per_language / n))))

    def sparse(batches):
        letters = letter_table()
        for batch in batches:
            kept = [(lang, features(t, letters), d) for lang, t, d in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            at = [np.flatnonzero(x) for _, x, _ in kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in kept], pa.string()),
                    pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()),
                    pa.array([k[1][a].tobytes() for k, a in zip(kept, at, strict=True)], pa.binary()),
                    pa.array([k[2] for k in kept], pa.int64()),
                ],
                names=["lang", "at", "value", "draw"],
            )

    sample = labelled.filter(keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    sample = sample.mapInArrow(sparse, "lang string, at binary, value binary, draw long")
    found = sample.orderBy("draw", "lang", "at", "value").limit(2 * rows_per_language * len(counts)).collect()
    x = np.zeros((len(found), sum(BINS)), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value, np.float32)
    return fit(x, [r.lang for r in found])


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row; null texts and texts of no letter are ``und``, score 0."""
    tune(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        letters = letter_table()
        for batch in batches:
            said = [model.predict(t, letters) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score = pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lang, score], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(``id_col``, held_out, lang_pred, score): a row per input row.

    Trains on labelled rows that are not held out (a null id is in no fold, so it is not trained on either) and
    predicts all. Predictions see the text alone. Without training rows, or for an empty table, every text is ``und``.
    Repeated rows get equal predictions; other columns are ignored.
    """
    out = held_out(id_col)
    model = train(docs.filter(F.col(id_col).isNotNull() & ~out), id_col, text_col, lang_col)
    return predict(docs, model, [F.col(id_col), out.alias("held_out")], text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = MIN_SCORE) -> DataFrame:
    """The rows whose language the model can tell, with all their columns; ``lang_col`` becomes what it tells.

    Null texts, texts of no letter and texts whose score is below ``least`` go. Without training rows no language can
    be told: then all texts with a letter stay, and their labels too. Training is that of `identify`. A table without
    the column of languages, or one of another type than text, keeps its columns as they are. Repeated rows stay or go
    together, and an empty table gives an empty one.
    """
    known = lang_col in docs.columns
    model = train(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col, text_col, lang_col) if known else LanguageModel()
    renamed = known and bool(model.families)

    def run(batches):
        letters = letter_table()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            if not model.families:
                yield batch.filter(pa.array([bool(t) and has_letter(t) for t in texts], pa.bool_()))
                continue
            told = [model.predict(t, letters) for t in texts]
            if renamed and pa.types.is_string(batch.schema.field(at := batch.schema.get_field_index(lang_col)).type):
                batch = batch.set_column(at, batch.schema.field(at), pa.array([lang for lang, _ in told], pa.string()))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
