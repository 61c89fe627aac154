"""Places that a reader has gone to, and back from."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .folds import folded

#: Places a history holds.
PLACES = 50


def history(moves: DataFrame, key: str, order: list[str], places: int = PLACES) -> DataFrame:
    """(key, n, shown, at, size) for each move of a key, n from 0: the place that is shown after it (null: it stays where it
    was), and the entry and the number of entries of the key's history.

    moves: key, order, kind, place, left. A `jump` writes `left` into the current entry and makes `place` the next; entries
    ahead are dropped. `back` and `forward` go one entry, if there is one, and show its place. `open` begins another document:
    entries of the document before stay, but going to one shows nothing. Other kinds and null show nothing and change nothing. A
    history holds the last `places` entries. Equal orders are in no defined order: make it unique."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, at, document = [(0, None)], 0, 0
        for n, (kind, place, left) in enumerate(rows):
            shown = None
            if kind == "jump":
                held[at] = (document, left)
                held[at + 1 :] = [(document, place)]
                held, shown = held[-places:], place
                at = len(held) - 1
            elif kind in ("back", "forward"):
                to = at + (1 if kind == "forward" else -1)
                if 0 <= to < len(held):
                    at = to
                    shown = held[at][1] if held[at][0] == document else None
            elif kind == "open":
                document += 1
            yield n, shown, at, len(held)

    kind = moves.schema["place"].dataType.simpleString()
    return folded(moves, key, order, ["kind", "place", "left"], fold, f"n long, shown {kind}, at int, size int")
