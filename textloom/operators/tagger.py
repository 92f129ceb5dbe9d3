"""Sequence tagging: features, decoding with a given model, tag formats and mention clean-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import shape_features


def token_features(tokens: DataFrame, reach: int = 2) -> DataFrame:
    """(sent_id, pos, token) -> shape features, and the word classes of the tokens ``reach`` to either side."""
    out = tokens.select("*", *[c.alias(f"f_{n}") for n, c in shape_features(F.col("token")).items()])
    w = Window.partitionBy("sent_id").orderBy("pos")
    return out.withColumn("f_before", F.lag("f_w", reach).over(w)).withColumn("f_after", F.lead("f_w", reach).over(w))


def tags_to_mentions(tagged: DataFrame) -> DataFrame:
    """(sent_id, pos, tag, type) with tags IO, IOB or IOBEW -> sent_id, type, start, end (tokens, end exclusive).

    A mention starts at B or W, and at I or E after O or a closed mention; running sums of starts number the mentions.
    """
    w = Window.partitionBy("sent_id").orderBy("pos")
    before = F.coalesce(F.lag("tag").over(w), F.lit("O"))
    starts = F.col("tag").isin("B", "W") | (F.col("tag").isin("I", "E") & (before == "O"))
    rows = tagged.withColumn("__n", F.sum((starts | (F.col("tag") == "O")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where("tag <> 'O'").groupBy("sent_id", "__n").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.max_by("type", "pos").alias("type")).select("sent_id", "type", "start", "end")


def mentions_to_tags(tokens: DataFrame, mentions: DataFrame, style: str = "IOB") -> DataFrame:
    """(sent_id, pos, token) + mentions -> tag in the style IO, IOB or IOBEW."""
    m = mentions.select(F.col("sent_id").alias("m_sent"), "start", "end")
    rows = tokens.join(m, (F.col("sent_id") == F.col("m_sent")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left")
    first, last = F.col("pos") == F.col("start"), F.col("pos") == F.col("end") - 1
    tag = {
        "IO": F.lit("I"),
        "IOB": F.when(first, "B").otherwise("I"),
        "IOBEW": F.when(first & last, "W").when(first, "B").when(last, "E").otherwise("I"),
    }[style]
    return rows.select(*tokens.columns, F.when(F.col("start").isNull(), "O").otherwise(tag).alias("tag"))


def merge_overlapping(mentions: DataFrame) -> DataFrame:
    """Overlapping mentions of one sentence and type become one: gaps and islands over starts."""
    w = Window.partitionBy("sent_id", "type").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = mentions.withColumn("__new", (reach.isNull() | (reach <= F.col("start"))).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("sent_id", "type", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("sent_id", "type", "start", "end")


def has_balanced_brackets(tokens: Column) -> Column:
    """Do brackets of any kind open and close in turn?"""
    step = lambda d, t: F.when(d < 0, d).when(t.isin("(", "[", "{"), d + 1).when(t.isin(")", "]", "}"), d - 1).otherwise(d)
    return F.aggregate(tokens, F.lit(0), step) == 0


def drop_unbalanced(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions (sent_id, start, end) whose tokens hold no unmatched bracket. ``sentences``: sent_id, tokens."""
    s = sentences.select(F.col("sent_id").alias("s_id"), F.col("tokens").alias("__tokens"))
    rows = mentions.join(s, F.col("sent_id") == F.col("s_id"))
    return rows.where(has_balanced_brackets(F.slice("__tokens", F.col("start") + 1, F.col("end") - F.col("start")))).select(*mentions.columns)


def read_piped(line: Column, mark: str = "|") -> Column:
    """"token|tag token|tag" -> array<struct<token, tag>>."""
    parts = F.filter(F.split(F.trim(line), r"\s+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, mark, 1).alias("token"), F.substring_index(p, mark, -1).alias("tag")))


def write_piped(tagged: Column) -> Column:
    return F.array_join(F.transform(tagged, lambda t: F.concat_ws("|", t["token"], t["tag"])), " ")


def read_spans(line: Column) -> Column:
    """"id|start end|text" -> struct<sent_id, start, end, text>."""
    p = F.split(line, r"\|", 3)
    place = F.split(F.get(p, F.lit(1)), " ")
    return F.struct(F.get(p, F.lit(0)).alias("sent_id"), F.get(place, F.lit(0)).cast("int").alias("start"), F.get(place, F.lit(1)).cast("int").alias("end"), F.get(p, F.lit(2)).alias("text"))


def viterbi(emissions: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> list[int]:
    """The best state sequence; ties go to the smaller state."""
    score, back = first + emissions[0], []
    for row in emissions[1:]:
        ways = score[:, None] + transitions
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + row
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def decode(sentences: DataFrame, model: dict, reverse: bool = False) -> DataFrame:
    """Tags of (sent_id, features array<array<string>>) by a linear chain: sent_id, tags.

    ``model``: states (list), weights {feature: [a weight a state]}, transitions (matrix), start (list).
    An order-2 chain is an order-1 chain over pairs of states. ``reverse`` reads from the end.
    """
    kind = sentences.schema["sent_id"].dataType.simpleString()
    shared = sentences.sparkSession.sparkContext.broadcast(model)  # a trained model, fixed before the job

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        states, weights = m["states"], {k: np.asarray(v, float) for k, v in m["weights"].items()}
        transitions, first = np.asarray(m["transitions"], float), np.asarray(m["start"], float)
        none = np.zeros(len(states))
        for pdf in batches:
            out = []
            for sent in pdf["features"]:
                rows = [sum((weights[f] for f in token if f in weights), none) for token in sent]
                rows = rows[::-1] if reverse else rows
                path = viterbi(np.stack(rows), transitions, first) if rows else []
                tags = [states[k] for k in path]
                out.append(tags[::-1] if reverse else tags)
            yield pd.DataFrame({"sent_id": pdf["sent_id"], "tags": out})

    return sentences.select("sent_id", "features").mapInPandas(run, f"sent_id {kind}, tags array<string>")


def train(sentences: DataFrame, epochs: int = 5) -> dict:
    """A linear chain by the averaged structured perceptron, from (sent_id, features, tags); for small labelled sets.

    One task streams the sentences; the model is bounded by the distinct features of the set.
    """
    import json

    rows = sentences.select("sent_id", "features", "tags").repartition(1).sortWithinPartitions("sent_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [(list(map(list, f)), list(t)) for pdf in batches for f, t in zip(pdf["features"], pdf["tags"], strict=True)]
        states = sorted({t for _, tags in data for t in tags})
        k = {s: n for n, s in enumerate(states)}
        weights: dict[str, np.ndarray] = {}
        totals: dict[str, np.ndarray] = {}
        trans, first = np.zeros((len(states),) * 2), np.zeros(len(states))
        t_trans, t_first, turn = trans.copy(), first.copy(), 1.0

        def move(features: list[list[str]], path: list[int], by: float) -> None:
            for token, s in zip(features, path, strict=True):
                for f in token:
                    weights.setdefault(f, np.zeros(len(states)))[s] += by
                    totals.setdefault(f, np.zeros(len(states)))[s] += by * turn
            first[path[0]] += by
            t_first[path[0]] += by * turn
            for a, b in zip(path, path[1:], strict=False):
                trans[a, b] += by
                t_trans[a, b] += by * turn

        for _ in range(epochs):
            for features, tags in data:
                if not features:
                    continue
                gold = [k[t] for t in tags]
                rows = np.stack([sum((weights[f] for f in token if f in weights), np.zeros(len(states))) for token in features])
                guess = viterbi(rows, trans, first)
                if guess != gold:
                    move(features, gold, 1.0)
                    move(features, guess, -1.0)
                turn += 1
        model = {
            "states": states,
            "weights": {f: (w - totals[f] / turn).tolist() for f, w in weights.items()},
            "transitions": (trans - t_trans / turn).tolist(),
            "start": (first - t_first / turn).tolist(),
        }
        yield pd.DataFrame({"model": [json.dumps(model)]})

    return json.loads(rows.mapInPandas(run, "model string").first()["model"])


def union_tags(a: Column, b: Column) -> Column:
    """Two taggers' tags as one: where the first says O the second counts."""
    return F.zip_with(a, b, lambda x, y: F.when(x == "O", y).otherwise(x))
