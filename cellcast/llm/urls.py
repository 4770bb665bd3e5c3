"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest wins. What
no rule decides is judged by a model trained on the driver from a small labelled table of urls, whose rows are
bounded by SAMPLE; the weights are an array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled urls that the model is trained on at most (those with the smallest hashes).
SAMPLE = 4000
#: Weights of the model, and the lengths of n-grams.
WIDTH, GRAMS = 1 << 16, (2, 3, 4)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + F.lit(3))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(rules: list[tuple[str, str, str]], host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """(rule, verdict) by the longest of the rules (verdict, host, path) that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):  # the last wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams of hosts and paths."""
    rows, found = [], []
    for salt, column in enumerate((host, path)):
        data, offsets = common.flat(column)
        owner = np.repeat(np.arange(len(column)), np.diff(offsets))
        for n in GRAMS:
            start = np.arange(max(0, len(data) - n + 1))
            start = start[owner[start] == owner[start + n - 1]] if len(start) else start
            value = common.span_hashes(data, start, start + n)
            found.append((common.mix(value + np.uint64(salt)) % np.uint64(WIDTH)).astype(np.int64))
            rows.append(owner[start])
    return np.concatenate(rows), np.concatenate(found)


class Model:
    """Logistic regression by full gradient steps with momentum; features of a url are scaled to length one."""

    def __init__(self, hosts: list[str], paths: list[str], labels: list[int], steps: int = 200, rate: float = 4.0, ridge: float = 1e-5):
        self.weights, self.bias = np.zeros(WIDTH), 0.0
        y = np.array(labels, float)
        if not len(y):
            return
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(share / (1 - share)))
        if 0 < y.sum() < len(y):
            row, feature = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
            scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
            velocity = np.zeros(WIDTH)
            for _ in range(steps):
                error = 1 / (1 + np.exp(-(self.bias + scale * np.bincount(row, self.weights[feature], len(y))))) - y
                gradient = np.bincount(feature, (error * scale)[row], WIDTH) / len(y) + ridge * self.weights
                velocity = 0.9 * velocity - rate * gradient
                self.weights += velocity
                self.bias -= float(error.mean())

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability that a url is to be blocked."""
        row, feature = features(host, path)
        n = len(host)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        return 1 / (1 + np.exp(-(self.bias + scale * np.bincount(row, self.weights[feature], n))))


def train(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> Model:
    """A model from (url, label 1 for block), of which at most `sample` distinct rows are used."""
    host, path = parts(url)
    rows = labelled.where(F.col(label).isNotNull()).select(host.alias("h"), path.alias("p"), F.col(label).cast("int").alias("y")).distinct()
    got = rows.orderBy(F.xxhash64("h", "p", "y"), "h", "p", "y").limit(sample).collect()
    return Model([r.h for r in got], [r.p for r in got], [r.y for r in got])


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], model: Model, id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; score is the model's, verdict the rule's or else by score.

    Null urls and urls without `://` have empty host and path and are judged by the model's bias. Other columns aren't
    read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text=2):
            score = pa.array(shared.value.score(batch.column(1), batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    host, path = parts(url)
    split = pages.select(F.col(id).cast("long").alias("i"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    scored = split.mapInArrow(run, "i long, host string, path string, score double")
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("i").alias(id), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
