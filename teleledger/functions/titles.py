"""Series titles out of program names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is taken out of a normalised name, in order, and what replaces it.
TITLE_RULES = [
    # broadcast tags, and notes in lenticular brackets other than one real title
    (r"\[[^\]]+\]", ""),
    (r"【(?!推しの子】)[^】]+】", ""),
    # bracketed subtitles
    (r"[（(<].*?[）)>]", ""),
    # episode, season and volume counters
    (r"第?[\d一二三四五六七八九十百]+[期章部回話目夜節]", " "),
    (r"(?i)(?:Season|Part|Vol|Volume|#|＃|♯)\.?\s*\d+", " "),
    (r"(?i)\d+(?:st|nd|rd|th)\s*Season", " "),
    # roman numerals: alone, or at the end
    (r"\s+[IVXLCDMivxlcdm]+(?:\s|$|\[|（|「|【)", " "),
    (r"(?<=[^\s])[IVXLCDMivxlcdm]+$", " "),
    # everything from a subtitle mark, a separator or a keyword on
    (r"\s+([\"“★☆▽▼「『(（\[【].*)", " "),
    (r"\s*[:：〜～\-－/／]{1,2}\s*.*$", ""),
    (r"\s+(?:決定戦|SP|スペシャル|総集編|見どころ|オリジナル版|特別編).*$", ""),
    # left-over marks and spaces
    (r"[-–――—〜～\s]+$", ""),
    (r"^\s+[-–――—〜～\s]+", ""),
    (r"\s{2,}", " "),
    (r"(?i)AnichU+$", ""),
]

_COMPILED = [(re.compile(pattern), replacement) for pattern, replacement in TITLE_RULES]


def clean_title(name: str | None) -> str | None:
    if name is None:
        return None
    title = unicodedata.normalize("NFKC", name.strip())
    for pattern, replacement in _COMPILED:
        title = pattern.sub(replacement, title)
    return title.strip()


@F.pandas_udf(T.StringType())
def series_title(names: pd.Series) -> pd.Series:
    """Arrow-batched, since Spark has no NFKC; meant for distinct names."""
    return names.map(clean_title)
