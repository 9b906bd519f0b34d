"""Bitmaps of bounded size that tell which keys are not wanted, to drop rows before they are shuffled."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve: 16 for each key, but no more than 16 MB, and bytes of one row of it.
BITS_EACH, MOST_BITS, SIEVE_ROW = 16, 1 << 27, 1 << 12


def sieve_of(keys: DataFrame) -> np.ndarray:
    """A bitmap with the places of all keys, 64-bit hashes in the column `key`, built in rows by the tasks.

    A key that isn't among them passes too where its place is taken, so what passes must still
    meet the keys; nothing that is among them is held back, however many there are.
    """
    wanted = BITS_EACH * max(keys.count(), 1)
    bits = min(MOST_BITS, max(8 * SIEVE_ROW, 1 << (wanted - 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    places = keys.select(place.alias("place")).distinct().select(F.shiftright("place", (8 * SIEVE_ROW).bit_length() - 1).alias("row"), "place")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(SIEVE_ROW, np.uint8)
        place = group["place"].to_numpy() % (8 * SIEVE_ROW)
        np.bitwise_or.at(row, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return pd.DataFrame({"row": group["row"].iloc[:1], "bytes": [row.tobytes()]})

    made = np.zeros(bits // 8, np.uint8)
    for r in places.groupBy("row").applyInPandas(run, "row bigint, bytes binary").collect():
        made[r["row"] * SIEVE_ROW : (r["row"] + 1) * SIEVE_ROW] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return made


def passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys, as unsigned numbers, a sieve lets through."""
    place = keys & np.uint64(len(sieve) * 8 - 1)
    return (sieve[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
