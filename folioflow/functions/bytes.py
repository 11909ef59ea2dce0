"""Byte-level conversions of model outputs: token ids to text, half-precision bits to numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL_IDS = 4


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for the
    characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def detokenize(ids: list[int], vocabulary: list[str]) -> str:
    """Text of token ids; ids of special tokens (up to 4) and unknown ones give nothing."""
    table = byte_of_character()
    text = "".join(vocabulary[i] for i in ids if SPECIAL_IDS < i < len(vocabulary))
    return bytes(table[c] for c in text if c in table).decode("utf-8", "replace")


def detokenized(ids: Column, vocabulary: list[str]) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else detokenize([int(i) for i in x], vocabulary))

    return F.pandas_udf(run, "string")(ids)


def half_values(bits: Column) -> Column:
    """Array of 16-bit patterns -> array of floats."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, np.int64).astype(np.uint16).view(np.float16).astype(np.float32).tolist())

    return F.pandas_udf(run, "array<float>")(bits)
