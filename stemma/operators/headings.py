"""Headings that run over several entries, and captures that hold a title, a body and a caption in one. Ordered folds over the entries of
one page or the characters of one capture, which bounds them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: Marks and words that decide what reads like a heading or begins a caption. Fixed values.
HEADING_MARK = r"^(#{1,6})\s+"
NO_HEADING_END = r"[.!?,;:]$"
DATE_OR_LINK = r"(?i)^(?:\d{1,4}[/-]){2}\d{1,4}\b|^https?://"
SMALL_WORDS = ("and", "of", "the", "to", "in", "for", "a", "an")
CAPTION_START = r"(?i)\b(?:Figure|Fig\.|Table)\s+\d+(?:\.\d+)*(?:[.:]|\b)"
MOST_CHARACTERS, MOST_WORDS, CAPITALS = 140, 16, 0.72


def _capitals(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(c == c.upper() for c in letters) / len(letters) if letters else 0.0


def reads_like_title(text: str) -> bool:
    """Short, without an end of a sentence, mostly capitals."""
    import re

    return bool(text) and len(text) <= MOST_CHARACTERS and not re.search(NO_HEADING_END, text) and len(text.split()) <= MOST_WORDS and _capitals(text) > CAPITALS


def reads_like_heading(text: str) -> bool:
    """A title, or words with a capital in front each, but for small words."""
    import re

    text = " ".join(text.split())
    if not text or len(text) > MOST_CHARACTERS or re.search(NO_HEADING_END, text) or re.search(DATE_OR_LINK, text) or len(text.split()) > MOST_WORDS or not any(c.isalpha() for c in text):
        return False
    words = [w for w in text.split() if any(c.isalpha() for c in w)]
    capital = lambda w: "A" <= w[0] <= "Z" and all(c.isalpha() or c in "'’&-" for c in w[1:])
    return _capitals(text) > CAPITALS or all(w in SMALL_WORDS or capital(w) for w in words)


def merge_wrapped(entries: DataFrame, keys: list[str], body: float = 10.0) -> DataFrame:
    """entries (keys, no, kind, markdown, raw, y) -> the same. Neighbours that are one heading in two parts become one: both of a level, or one a
    heading and the other reading like one, close by and short together. Of a page's first eight entries, a plain title that one of the
    next three repeats as a heading goes, once."""
    import re

    reach = max(22.0, body * 3.2)

    def level(markdown: str) -> int:
        found = re.match(HEADING_MARK, markdown or "")
        return len(found[1]) if found else 0

    def one(a: dict, b: dict) -> bool:
        if a["kind"] != "text" or b["kind"] != "text" or a["raw"] is None or b["raw"] is None:
            return False
        if len(a["raw"]) + len(b["raw"]) > 160 or not abs(b["y"] - a["y"]) <= reach:
            return False
        x, y = level(a["markdown"]), level(b["markdown"])
        if x and y:
            return x == y and reads_like_heading(a["raw"]) and reads_like_heading(b["raw"])
        return bool(x) and reads_like_heading(b["raw"]) or bool(y) and reads_like_heading(a["raw"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in part.sort_values("no").to_dict("records"):
            if out and one(out[-1], row):
                text = " ".join(f"{out[-1]['raw']} {row['raw']}".split())
                depth = min(max(1, level(out[-1]["markdown"])), max(1, level(row["markdown"])))
                out[-1] |= {"raw": text, "markdown": f"{'#' * depth} {text}"}
            else:
                out.append(row)
        for i, row in enumerate(out[:8]):
            if row["kind"] != "text" or row["raw"] is None or level(row["markdown"]) or not reads_like_heading(row["raw"]):
                continue
            own = " ".join(row["raw"].split()).lower()
            if any(level(x["markdown"]) and x["raw"] is not None and " ".join(x["raw"].split()).lower() == own for x in out[i + 1 : i + 4]):
                del out[i]
                break
        return pd.DataFrame(out, columns=part.columns)

    return entries.groupBy(*keys).applyInPandas(run, entries.schema)


def split_capture(chars: DataFrame, keys: list[str]) -> DataFrame:
    """chars (keys, no, text, size): the characters of a capture that came as one line -> (keys, part, kind, text): its title in larger type, its body
    and its last caption, where it has a title or a caption; else the whole as body."""
    import re

    def parts(texts: list[str], sizes: list[float]) -> list[tuple[str, str]]:
        plain = lambda x: " ".join("".join(x).split())
        whole = [("body", plain(texts))]
        if len(texts) < 4:
            return whole
        usual = sorted(s for t, s in zip(texts, sizes, strict=True) if t.strip() and 4 < s < 60)
        normal = usual[len(usual) // 2] if usual else 10.0
        begin = next((i for i, t in enumerate(texts) if t.strip()), len(texts))
        end = next((i for i in range(begin, len(texts)) if texts[i].strip() and sizes[i] < normal * 1.22), len(texts))
        title = plain(texts[begin:end])
        titled = sum(bool(t.strip()) for t in texts[begin:end]) >= 3 and reads_like_title(title)
        rest = "".join(texts[end if titled else begin :])
        captions = list(re.finditer(CAPTION_START, rest))
        at = captions[-1].start() if captions else -1
        if at >= 0 and (len(rest[at:].split()) > 28 or len(plain(rest[at:])) > 220):
            at = -1
        out = [("title", title)] * titled + ([("body", plain(rest[:at])), ("caption", plain(rest[at:]))] if at >= 0 else [("body", plain(rest))])
        out = [x for x in out if x[1]]
        return out if len(out) >= 2 else whole

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("no")
        found = parts([t or "" for t in part["text"]], part["size"].tolist())
        return pd.DataFrame([[*(part[k].iloc[0] for k in keys), i, *x] for i, x in enumerate(found)], columns=[*keys, "part", "kind", "text"])

    kinds = ", ".join(f"`{k}` {chars.schema[k].dataType.simpleString()}" for k in keys)
    return chars.groupBy(*keys).applyInPandas(run, f"{kinds}, part long, kind string, text string")
