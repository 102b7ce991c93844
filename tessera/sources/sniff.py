"""What kind of file something is, where its header stands, and which of its columns hold numbers.

These run on the driver over the first bytes or rows of a file and choose a
contract; the data themselves are read by Spark.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

ENCODINGS = "utf-8", "utf-8-sig", "latin-1", "cp1252"
MAGIC = {b"PK\x03\x04": "xlsx", b"\xd0\xcf\x11\xe0": "xls", b"%PDF": "pdf", b"PAR1": "parquet", b"\x1f\x8b": "gz"}


@dataclass(frozen=True)
class FileKind:
    kind: str
    encoding: str | None = None
    delimiter: str | None = None


def detect(name: str, head: bytes) -> FileKind:
    """The kind by its first bytes, then by its name; for text the encoding and delimiter as well."""
    for magic, kind in MAGIC.items():
        if head.startswith(magic):
            return FileKind(kind)
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending in {"json", "obo", "yaml", "yml"}:
        return FileKind("yaml" if ending == "yml" else ending, _encoding(head)[0])
    encoding, text = _encoding(head)
    return FileKind("tsv" if ending == "tsv" else "csv", encoding, "\t" if ending == "tsv" else delimiter(text))


def _encoding(head: bytes) -> tuple[str, str]:
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig", head.decode("utf-8-sig", "ignore")
    for e in ENCODINGS:
        try:
            return e, head.decode(e)
        except UnicodeDecodeError as error:
            if error.start > len(head) - 4:  # a character cut off at the end
                return e, head.decode(e, "ignore")
    return ENCODINGS[-1], head.decode(ENCODINGS[-1], "replace")


def delimiter(text: str) -> str:
    """The delimiter that gives most fields in the first lines, the same number in each."""
    lines = [x for x in text.splitlines()[:20] if x.strip()]

    def worth(d: str) -> tuple[int, int]:
        n = [len(r) for r in csv.reader(lines, delimiter=d)]
        return (min(n, default=0) if len(set(n)) <= 1 else 0), max(n, default=0)

    return max(",;\t|", key=worth)


def header_row(rows: Sequence[Sequence[object]], needles: Sequence[str], depth: int = 30) -> int | None:
    """The first of the top rows with one of the needles in a cell."""
    wanted = {n.strip().lower() for n in needles}
    for i, row in enumerate(rows[:depth]):
        if any(str(c).strip().lower() in wanted for c in row if c is not None):
            return i
    return None


def merged_header(upper: Sequence[str | None], lower: Sequence[str | None]) -> list[str]:
    """Two header rows as one; a cell of the upper one stands for those to its right up to the next."""
    out, last = [], ""
    for a, b in zip(upper, lower):
        last = (a or "").strip() or last
        b = (b or "").strip()
        out.append(f"{last} / {b}" if last and b and last != b else b or last)
    return out


def numeric_share(values: Sequence[object]) -> float:
    filled = [str(v).strip().replace(",", ".") for v in values if v is not None and str(v).strip()]

    def number(v: str) -> bool:
        try:
            float(v)
        except ValueError:
            return False
        return True

    return sum(map(number, filled)) / len(filled) if filled else 0.0


def sheet_role(header: Sequence[str], rows: Sequence[Sequence[object]], key_names: Sequence[str]) -> str:
    """metadata, foods_spine, nutrient_sheet or unknown, by key columns and the share of numeric columns."""
    if len(rows) < 3 or len(header) < 2:
        return "metadata"
    has_key = any(h and h.strip().lower() in {k.lower() for k in key_names} for h in header)
    numeric = sum(numeric_share([r[i] for r in rows[:200] if i < len(r)]) >= 0.6 for i in range(len(header)))
    if has_key:
        return "nutrient_sheet" if numeric >= max(2, len(header) // 2) else "foods_spine"
    return "unknown"
