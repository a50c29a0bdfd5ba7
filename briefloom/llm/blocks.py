"""Compare members of groups block against block, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spanning(hit: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of ``hit`` the least row index of their component, -1 where there is no link."""
    na, nb = hit.shape
    top = na + nb

    def least(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least value over each row's links, some rows at a time."""
        out = np.full(len(matrix), top, np.int32)
        for at in range(0, len(matrix), 256):
            out[at : at + 256] = np.where(matrix[at : at + 256], values[None, :], np.int32(top)).min(axis=1, initial=top)
        return out

    r, c = np.arange(na, dtype=np.int32), (np.arange(na, dtype=np.int32) if same else np.full(nb, top, np.int32))
    while True:
        r2 = np.minimum(r, least(hit, c))
        c2 = np.minimum(c, least(hit.T, r2))
        if same:
            r2 = c2 = np.minimum(r2, c2)
            r2 = c2 = np.minimum(r2, r2[np.minimum(r2, na - 1)])
        if (r2 == r).all() and (c2 == c).all():
            return np.where(hit.any(axis=1), r, -1), np.where(hit.any(axis=0), c, -1)
        r, c = r2, c2


def block_cells(block: Column, blocks: Column) -> Column:
    """Array of (i, j, side): the block pairs a member of ``block`` takes part in; side 2 is both at once."""
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(
            F.least(block, o).alias("i"),
            F.greatest(block, o).alias("j"),
            F.when(block == o, 2).when(block < o, 0).otherwise(1).alias("side"),
        ),
    )


def compared(members: DataFrame, payload: str, hits: Callable[[list, list | None], np.ndarray]) -> DataFrame:
    """(rep, links, root) rows of ``members(task, sub, side, rep, mult, <payload>)``.

    Members with equal ``task`` meet in one task, and those with equal ``sub`` are compared:
    sides 0 and 1 with each other, side 2 among themselves.  ``hits`` gives the boolean matrix
    of links.  A rep's links (weighted by ``mult``) add up over its rows; ``rep``-``root`` edges
    span the links found.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if pdf["rep"].duplicated().any():  # repeated rows
            same_bytes = pdf[payload].map(lambda x: x if isinstance(x, bytes) else np.asarray(x).tobytes())
            pdf = pdf[~pdf.assign(__same=same_bytes).duplicated(["sub", "side", "rep", "__same"])]
        for _, part in pdf.groupby("sub", sort=False):
            left, right = part[part["side"] == 0], part[part["side"] == 1]
            same = bool((part["side"] == 2).all())
            if same:
                left = right = part
            if not len(left) or not len(right):
                continue
            hit = hits(left[payload].tolist(), None if same else right[payload].tolist())
            ra, rb = left["rep"].to_numpy(), right["rep"].to_numpy()
            r, c = spanning(hit, same)
            for ids, root, count in ((ra, r, hit @ right["mult"].to_numpy()), (rb, c, left["mult"].to_numpy() @ hit)):
                got = root >= 0
                out.append(pd.DataFrame({"rep": ids[got], "links": count[got].astype(np.int64), "root": ra[root[got]]}))
                if same:
                    break
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")

    return members.groupBy("task").applyInPandas(compare, "rep long, links long, root long")
