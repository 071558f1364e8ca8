"""Whether one text says what another one says: by shared words and polarity, by a model's outputs, or by both."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plumbline.functions import words
from plumbline.functions.once import once
from plumbline.functions.scoring import clamp01

#: Words that say nothing about what a text says.
STOP = (*words.STOP, "can", "could", "should", "would", "may", "might")
#: What each label is called, in the order of models that do not name them, and the model's weight in a blend.
LABELS, MODEL_SHARE = ("contradict", "neutral", "entail"), 0.70
#: Scores of pairs with a blank side, and of pairs with a side without words.
SILENT, WORDLESS = (0.0, 0.0, 1.0), (0.25, 0.25, 0.50)

Model = Callable[[list[tuple[str, str]]], Sequence[Sequence[float]]]


def _made(entail: Column, contradict: Column, neutral: Column) -> Column:
    """The three as shares of their sum."""
    return once(
        F.struct(entail.alias("e"), contradict.alias("c"), neutral.alias("n")),
        lambda x: once(F.greatest(F.lit(1e-9), x["e"] + x["c"] + x["n"]), lambda s: F.struct((x["e"] / s).alias("entail"), (x["c"] / s).alias("contradict"), (x["n"] / s).alias("neutral"))),
    )


def _fixed(values: tuple[float, float, float]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("entail", "contradict", "neutral"), strict=True)])


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rule_scores(text: Column, other: Column) -> Column:
    """entail, contradict and neutral of ``text`` by ``other``, from the share of its words that the other has and from their polarities."""
    tokens = lambda x: words.token_set(x, words.ALPHA, STOP)
    seen = F.struct(tokens(text).alias("own"), tokens(other).alias("oth"), (words.has(text, words.NEGATED_NLI) != words.has(other, words.NEGATED_NLI)).cast("double").alias("m"))

    def scored(s: Column) -> Column:
        def from_share(o: Column) -> Column:
            contradict, entail = _sigmoid(1.4 * o + 1.8 * s["m"] - 1.3), _sigmoid(1.6 * o + 1.2 * (1 - s["m"]) - 1.4)
            return _made(entail, contradict, F.greatest(F.lit(0.0), 1 - F.greatest(entail, contradict)))

        share = words.shared(s["own"], s["oth"]) / F.greatest(F.lit(1), F.size(s["own"]))
        return F.when((F.size(s["own"]) == 0) | (F.size(s["oth"]) == 0), _fixed(WORDLESS)).otherwise(once(share, from_share))

    blank = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(other, F.lit("")) == "")
    return F.when(blank, _fixed(SILENT)).otherwise(once(seen, scored))


def decoded(raw: Column, labels: Sequence[str] = LABELS) -> Column:
    """The scores that a model's raw outputs stand for; null for none.

    One output is the logit of entailment; of two the first contradicts and the
    second entails; three or more are named by ``labels``, unknown names in the
    order of LABELS.
    """

    def softmax(v: Column) -> Column:
        bounded = F.transform(v, lambda x: F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x)))

        def shares(b: Column) -> Column:
            exps = F.transform(b, lambda x: F.exp(x - F.array_max(b)))
            return once(exps, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))

        return once(bounded, shares)

    def named(p: Column) -> Column:
        # of several outputs with one meaning the last one counts
        place = {}
        for i, label in enumerate(labels):
            low = label.lower()
            for meaning, marks in (("entail", ("entail",)), ("contradict", ("contrad", "refut")), ("neutral", ("neutral",))):
                if any(m in low for m in marks):
                    place[meaning] = i
                    break
        place = place or {n: i for i, n in enumerate(LABELS)}
        at = lambda n: F.coalesce(F.get(p, F.lit(place[n])), F.lit(0.0)) if n in place else F.lit(0.0)
        return _made(at("entail"), at("contradict"), at("neutral"))

    one = once(_sigmoid(F.get(raw, F.lit(0))), lambda e: _made(e, F.greatest(F.lit(0.0), 1 - e), F.lit(0.0)))
    many = once(softmax(raw), lambda p: F.when(F.size(p) == 2, _made(p[1], p[0], F.greatest(F.lit(0.0), 1 - F.greatest(p[0], p[1])))).otherwise(named(p)))
    return F.when(F.coalesce(F.size(raw), F.lit(0)) > 0, F.when(F.size(raw) == 1, one).otherwise(many))


def blended(model: Column, rules: Column, share: float = MODEL_SHARE) -> Column:
    """Both scores, the model's with weight ``share``; where it has none, those of the rules."""
    part = lambda n: clamp01(share * model[n] + (1 - share) * rules[n])
    return F.when(model.isNull(), rules).otherwise(_made(part("entail"), part("contradict"), part("neutral")))


def with_model_outputs(rows: DataFrame, load: Callable[[], Model], text_col: str, other_col: str, out: str = "raw", batch: int = 64) -> DataFrame:
    """``rows`` with a model's raw outputs for each pair of texts, as an array of doubles.

    ``load`` is called once for each task, the model for ``batch`` pairs at a
    time. Pairs with a blank side are not asked. Where the model cannot be
    loaded, or fails on a batch, the outputs are null, so that rules can step in.
    """
    names = rows.columns
    text_at, other_at = names.index(text_col), names.index(other_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            model = load()
        except Exception:  # whatever a model's loader raises
            model = None
        for b in batches:
            texts, others = b.column(text_at).to_pylist(), b.column(other_at).to_pylist()
            found: list[list[float] | None] = [None] * b.num_rows
            asked = [i for i in range(b.num_rows) if texts[i] and others[i]] if model else []
            for lo in range(0, len(asked), batch):
                part = asked[lo : lo + batch]
                try:
                    for i, x in zip(part, model([(texts[i], others[i]) for i in part]), strict=True):
                        found[i] = [float(v) for v in x]
                except Exception:
                    continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def with_model_entities(rows: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[Sequence[str]]]], text_col: str, out: str = "entities", batch: int = 32) -> DataFrame:
    """``rows`` with the entities that a model finds in a text: lower-case, trimmed, each once, none about sources.

    ``load`` is called once for each task, the model for ``batch`` texts at a
    time. Blank texts are not asked; where the model cannot be loaded or fails,
    there are no entities, so that rules can step in.
    """
    from plumbline.functions.entities import truth_entities

    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            model = load()
        except Exception:  # whatever a model's loader raises
            model = None
        for b in batches:
            texts = b.column(at).to_pylist()
            found: list[list[str]] = [[] for _ in texts]
            asked = [i for i, t in enumerate(texts) if t and t.strip()] if model else []
            for lo in range(0, len(asked), batch):
                part = asked[lo : lo + batch]
                try:
                    for i, names in zip(part, model([texts[i] for i in part]), strict=True):
                        found[i] = [n for n in names if isinstance(n, str)]
                except Exception:
                    continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, out])

    told = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(StringType()))]))
    return told.withColumn(out, truth_entities(F.col(out)))
