"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut

#: Vectors that k-means is fitted on, about, vectors of that sample for each cell at least, vectors of a label aimed at in a cell, and cells at least.
SAMPLE, PER_CELL, AIM, CELLS = 8192, 8, 256, 4
ROUNDS = 8
#: Vectors of one block; two blocks of a cell meet in one task, ROWS rows of their product at a time.
BLOCK, ROWS = 4096, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), np.finfo(float).tiny)


def fit_cells(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means over the sample's rows; starts from evenly spaced rows, an empty cell keeps its centre."""
    x = _unit(np.asarray(sample, float))
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        centres[full] = _unit(sums[full])
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, least: float) -> list[list[int]]:
    """Per unit vector its cell and, after it, the lower-numbered cells in which a vector of cosine `least` or more to it may lie.

    If y is nearest to centre c and x to h, then x.h - x.c <= (x - y).(h - c) <= |x - y| |h - c|, with |x - y| <= sqrt(2 - 2 least).
    """
    dots = x @ centres.T
    home = np.argmax(dots, axis=1)
    apart = np.linalg.norm(centres[home][:, None, :] - centres[None, :, :], axis=2)
    reach = dots[np.arange(len(x)), home][:, None] - dots <= np.sqrt(max(0.0, 2 - 2 * least)) * apart + 1e-9
    reach &= np.arange(len(centres))[None, :] < home[:, None]
    return [[int(h), *np.flatnonzero(r).tolist()] for h, r in zip(home, reach, strict=True)]


def near_matrix(x: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x have a cosine of at least `least`, in double precision."""
    norm = np.linalg.norm(x, axis=1)
    if not np.all(np.isfinite(norm) & (norm > 1e-150)):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
    out = np.empty((len(x), len(x)), bool)
    for at in range(0, len(x), ROWS):
        out[at : at + ROWS] = (x[at : at + ROWS] @ x.T) / (norm[at : at + ROWS, None] * norm[None, :]) >= least
    return out


def spanning(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id that it reaches) for the rows of a symmetric matrix of links that reach a lesser id."""
    by = np.argsort(ids, kind="stable")
    label, rank = np.empty(len(ids), np.int64), np.arange(len(ids))
    label[by] = rank  # ranks of ids
    linked = np.flatnonzero(near.any(axis=1))
    while len(linked):
        before = label.copy()
        for k in range(0, len(linked), ROWS):
            rows = linked[k : k + ROWS]
            label[rows] = np.minimum(label[rows], np.where(near[rows], label[None, :], len(ids)).min(axis=1))
        label = label[by][label]  # what the reached one reaches
        if np.array_equal(before, label):
            break
    return [(int(ids[i]), int(ids[by[label[i]]])) for i in linked if ids[by[label[i]]] < ids[i]]


def link_embeddings(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: rows with equal labels and a cosine of at least `least` (in double precision) are linked.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths
    don't link either. n_links counts the other rows linked directly, component_id is the smallest vec_id reachable by links, itself
    included, kept says that the row is its group's representative. vec_id must be a whole number; rows with equal vec_id are one node.

    Other columns are ignored, whatever their names; an empty table gives no rows; copies, however many, are compared once.

    Equal vectors of a label are one class. Classes are assigned to cells of spherical k-means, fitted on a sample of at most about SAMPLE
    vectors (which decides nothing but the cells), and visit the other cells where a link may lie, so no link is lost. Within a cell,
    blocks of about BLOCK classes meet in one task each, by matrix products; a task returns counts and links that span what it joins. The
    number of cells follows the size of the largest label, up to what the sample can place.
    """
    key = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(key, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(key, lambda x: x != 0)
    plain = F.transform(key, lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType):
        plain = plain.cast("array<float>")  # as given, for half the bytes; cosines are in double precision
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.when(F.coalesce(sound, F.lit(False)), plain).alias("v")), "vectors")
    rows = rows.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256)))
    classes = cut(rows.where("v is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "vector-classes")
    counts = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    dims = [r[0] for r in counts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(1).select("dim").collect()]
    k, centres = min(SAMPLE // PER_CELL, max(CELLS, -(-(top["n"] or 0) // AIM))), None
    if dims:
        share = max(1, (top["all"] or 0) // SAMPLE)
        sample = classes.where((F.size("v") == dims[0]) & (F.pmod(F.xxhash64("digest"), F.lit(share)) == 0)).select("digest", "v").orderBy("digest").limit(2 * SAMPLE).collect()
        centres = fit_cells(np.array([r["v"] for r in sample]), k) if len(sample) > k else None

    def assign(batches):
        for pdf in batches:
            found = [[0]] * len(pdf)
            if centres is not None:
                fit = np.array([len(v) == centres.shape[1] for v in pdf["v"]], bool)
                for at in np.array_split(np.flatnonzero(fit), max(1, int(fit.sum()) // 1024)):
                    if len(at):
                        for i, cells in zip(at, cells_of(_unit(np.stack(pdf["v"].iloc[at]).astype(float)), centres, least), strict=True):
                            found[i] = cells
            yield pd.DataFrame({"label": pdf["label"], "digest": pdf["digest"], "cells": found})

    cells = classes.select("label", "digest", "v").mapInPandas(assign, "label string, digest string, cells array<int>")
    placed = cut(cells.select("label", "digest", F.posexplode("cells").alias("visit", "cell")), "vector-cells")
    sizes = cut(placed.groupBy("label", "cell").agg(F.count("*").alias("n")).select("label", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cell-sizes")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    member = placed.join(sizes, ["label", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("label", "digest", "visit", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        ids, copies, linked, edges = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), np.zeros(len(pdf), np.int64), []
        own, home = pdf["own"].to_numpy(), pdf["visit"].to_numpy() == 0
        sizes = np.array([len(v) for v in pdf["v"]])
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            near = near_matrix(np.stack(pdf["v"].iloc[at]).astype(float), least)
            # a pair is met where both are at home, or where one is and the other visits from a later cell
            near &= home[at][:, None] | home[at][None, :]
            near &= (own[at][:, None] != own[at][None, :]) if lo != hi else ~np.eye(len(at), dtype=bool)
            for row in range(0, len(at), ROWS):  # a product of whole numbers turns its rows into such
                linked[at[row : row + ROWS]] += near[row : row + ROWS] @ copies[at]
            edges += spanning(near, ids[at])
        out = pd.DataFrame({"label": pdf["label"], "digest": pdf["digest"], "n": linked, "src": -1, "dst": -1})[linked > 0]
        return pd.concat([out, pd.DataFrame([(None, None, 0, a, b) for a, b in edges], columns=list(out.columns))]) if edges else out

    full = member.join(classes.select("label", "digest", "id", "copies", "v"), ["label", "digest"])
    met = cut(full.groupBy("label", "cell", "lo", "hi").applyInPandas(compare, "label string, digest string, n long, src long, dst long"), "vector-links")
    found = cut(components(met.where("label is null").select("src", "dst"), "vector-components"), "vector-found")
    direct = met.where("label is not null").groupBy("label", "digest").agg(F.sum("n").alias("n"))
    named = classes.select("label", "digest", "id", "copies").join(direct, ["label", "digest"], "left").join(found, "id", "left")
    named = named.select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    named = cut(named.where("n > 0"), "vector-named")
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    least_id = F.least(F.coalesce("component", "vec_id"), "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), least_id.alias("component_id"), (F.col("vec_id") == least_id).alias("kept"))
