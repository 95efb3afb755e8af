"""Pluggable text scorers: a name, and a function from a batch of texts to scores, run as a pandas UDF over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NEGATIVE, POSITIVE, STRIPPED
from ..plans.shipping import ship

Scorer = Callable[[pd.Series], pd.DataFrame]
SCHEMA = "positive_score double, negative_score double, neutral_score double, sentiment_score double"
SCORERS: dict[str, Callable[[], Scorer]] = {}


def register(name: str, build: Callable[[], Scorer]) -> None:
    """``build`` is called once a task, so a model is loaded once a worker."""
    SCORERS[name] = build


def lexicon(positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Scorer:
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts.fillna(""):
            words = [w.strip(STRIPPED) for w in text.lower().split()]
            p, n = sum(w in positive for w in words), sum(w in negative for w in words)
            total = p + n + 1.0
            rows.append((p / total, n / total, 1 / total, (p - n) / total))
        return pd.DataFrame(rows, columns=["positive_score", "negative_score", "neutral_score", "sentiment_score"])

    return score


register("lexicon", lexicon)


class WeightsMissing(RuntimeError):
    """A transformer scorer without its library or its weights on disk; nothing is ever downloaded."""


def transformer(path: str, batch: int = 64, device: str | None = None) -> Scorer:
    """A local three-way text classifier (labels positive, negative, neutral) of the ``transformers`` library, loaded once a task."""
    try:
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer
    except ImportError as e:
        raise WeightsMissing(f"{path}: {e}") from e
    try:
        tokens = AutoTokenizer.from_pretrained(path, local_files_only=True)
        model = AutoModelForSequenceClassification.from_pretrained(path, local_files_only=True).eval()
    except OSError as e:
        raise WeightsMissing(f"{path}: {e}") from e
    if device:
        model.to(device)
    at = {name.lower(): int(i) for i, name in model.config.id2label.items()}

    def score(texts: pd.Series) -> pd.DataFrame:
        parts = []
        values = texts.fillna("").tolist()
        for lo in range(0, len(values), batch):
            with torch.no_grad():
                x = tokens(values[lo : lo + batch], return_tensors="pt", truncation=True, padding=True).to(model.device)
                parts.append(torch.softmax(model(**x).logits, dim=-1).cpu().numpy())
        p = {k: [float(r[at[k]]) for part in parts for r in part] for k in ("positive", "negative", "neutral")}
        out = pd.DataFrame({"positive_score": p["positive"], "negative_score": p["negative"], "neutral_score": p["neutral"]})
        return out.assign(sentiment_score=out.positive_score - out.negative_score)

    return score


def score(df: DataFrame, text: str, model: str) -> DataFrame:
    """``df`` with a ``score`` struct by the named scorer."""
    ship(df.sparkSession)
    build = SCORERS[model]

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = build()
        for batch in batches:
            yield scorer(batch)

    return df.withColumn("score", run(F.col(text)))
