"""Constraint propagation on 9 x 9 puzzles, relational: candidates, singles, dead units; search by puzzle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(puzzles: DataFrame) -> DataFrame:
    """(puzzle_id, cell, value) of boards of 81 characters; 0 and . are empty (null)."""
    rows = puzzles.where(F.length("board") == 81).select("puzzle_id", F.posexplode(F.split("board", "")).alias("cell", "c"))
    return rows.where("cell < 81").select("puzzle_id", "cell", F.when(~F.col("c").isin("0", "."), F.col("c")).try_cast("int").alias("value"))


def units(cell: Column) -> list[Column]:
    """The row, column and box of a cell, as names."""
    row, col = F.floor(cell / 9), cell % 9
    return [F.concat(F.lit("r"), row.cast("string")), F.concat(F.lit("c"), col.cast("string")), F.concat(F.lit("b"), (F.floor(row / 3) * 3 + F.floor(col / 3)).cast("string"))]


def candidates(board: DataFrame) -> DataFrame:
    """(puzzle_id, cell, value): what may stand in an empty cell, all digits without those of its peers."""
    long = board.withColumn("unit", F.explode(F.array(*units(F.col("cell")))))
    taken = long.where("value is not null").groupBy("puzzle_id", "unit").agg(F.collect_set("value").alias("taken"))
    free = long.where("value is null").join(taken, ["puzzle_id", "unit"], "left").groupBy("puzzle_id", "cell").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("taken", F.array().cast("array<int>"))))).alias("taken"))
    digits = F.array(*(F.lit(d) for d in range(1, 10)))
    return free.select("puzzle_id", "cell", F.explode_outer(F.array_except(digits, "taken")).alias("value"))


def naked_singles(options: DataFrame) -> DataFrame:
    return options.where("value is not null").groupBy("puzzle_id", "cell").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def hidden_singles(options: DataFrame) -> DataFrame:
    """Digits with one place left in a unit."""
    long = options.where("value is not null").withColumn("unit", F.explode(F.array(*units(F.col("cell")))))
    return long.groupBy("puzzle_id", "unit", "value").agg(F.min("cell").alias("cell"), F.count(F.lit(1)).alias("n")).where("n = 1").select("puzzle_id", "cell", "value").distinct()


def fewest(options: DataFrame) -> DataFrame:
    """The empty cell with fewest candidates of each puzzle; of equal ones the first."""
    n = options.groupBy("puzzle_id", "cell").agg(F.count("value").alias("n"))
    return n.groupBy("puzzle_id").agg(F.min_by("cell", F.struct("n", "cell")).alias("cell"), F.min("n").alias("n"))


def propagated(board: DataFrame, rounds: int = 30) -> DataFrame:
    """Boards after filling singles until nothing changes; rounds bounds the loop (a board has 81 cells)."""
    from ..plans.runtime import materialize

    board = materialize(board, "board")
    for _ in range(rounds):
        options = candidates(board)
        found = naked_singles(options).unionByName(hidden_singles(options)).groupBy("puzzle_id", "cell").agg(F.min("value").alias("new"))
        board, before = materialize(board.join(found, ["puzzle_id", "cell"], "left").select("puzzle_id", "cell", F.coalesce("value", "new").alias("value")), "board"), board
        if board.where("value is null").count() == before.where("value is null").count():
            break
    return board


def _solve(board: list[int]) -> list[int] | None:
    rows, cols, boxes = [0] * 9, [0] * 9, [0] * 9
    empty = []
    for k, v in enumerate(board):
        if v:
            bit = 1 << v
            if (rows[k // 9] | cols[k % 9] | boxes[k // 27 * 3 + k % 9 // 3]) & bit:
                return None
            rows[k // 9] |= bit
            cols[k % 9] |= bit
            boxes[k // 27 * 3 + k % 9 // 3] |= bit
        else:
            empty.append(k)

    def go() -> bool:
        if not empty:
            return True
        best = min(empty, key=lambda k: (9 - bin(rows[k // 9] | cols[k % 9] | boxes[k // 27 * 3 + k % 9 // 3]).count("1"), k))
        empty.remove(best)
        r, c, b = best // 9, best % 9, best // 27 * 3 + best % 9 // 3
        for v in range(1, 10):
            bit = 1 << v
            if not (rows[r] | cols[c] | boxes[b]) & bit:
                rows[r] |= bit
                cols[c] |= bit
                boxes[b] |= bit
                board[best] = v
                if go():
                    return True
                rows[r] ^= bit
                cols[c] ^= bit
                boxes[b] ^= bit
        board[best] = 0
        empty.append(best)
        return False

    return board if go() else None


def solved(puzzles: DataFrame) -> DataFrame:
    """(puzzle_id, board, solution): backtracking on the cell with fewest candidates; null where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["board"]:
                fine = isinstance(x, str) and len(x) == 81
                found = _solve([int(c) if c.isdigit() else 0 for c in x]) if fine else None
                out.append("".join(map(str, found)) if found else None)
            yield pd.DataFrame({"puzzle_id": b["puzzle_id"], "board": b["board"], "solution": out})

    return puzzles.select("puzzle_id", "board").mapInPandas(run, "puzzle_id long, board string, solution string")
