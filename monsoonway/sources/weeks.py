"""Weeks, months and the files that hold them: which inputs a window of time needs."""

from __future__ import annotations

import csv
import json
import re
from datetime import date, timedelta
from pathlib import PurePosixPath

_MONTH = re.compile(r"(?<!\d)(\d{4})-(\d{2})(?!\d)")
_STAMP = re.compile(r"(?<!\d)(\d{4})(\d{2})(\d{2})T")
_WEEK = re.compile(r"^week_(\d{4})_(\d{2})_(\d{2})$")


def day_list(first: date, last: date) -> list[date]:
    """All days from first to last, both included; none if last is earlier."""
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def month_list(first: date, last: date) -> list[tuple[int, int]]:
    """(year, month) of all months that hold a day from first to last."""
    return sorted({(d.year, d.month) for d in day_list(first, last)})


def week_starts(first: date, last: date) -> list[date]:
    """Days that start a 7-day window counted from first: 53 in a leap year."""
    return day_list(first, last)[::7]


def months_needed(paths: list[str], first: date, last: date) -> list[str]:
    """Monthly files (…-YYYY-MM…) whose month has a day in the window; files without a month in their name stay."""
    wanted = set(month_list(first, last))
    out = []
    for p in paths:
        found = _MONTH.search(PurePosixPath(p).name)
        if not found or (int(found[1]), int(found[2])) in wanted:
            out.append(p)
    return out


def days_needed(paths_by_day: dict[date, str], first: date, last: date) -> list[str]:
    """The file of each day of the window; a day without one is an error."""
    missing = [d.isoformat() for d in day_list(first, last) if d not in paths_by_day]
    if missing:
        raise FileNotFoundError(f"no raster for {', '.join(missing)}")
    return [paths_by_day[d] for d in day_list(first, last)]


def stamped_in_week(paths: list[str], start: date) -> list[str]:
    """Files stamped YYYYMMDDT… within the 7 days from start."""
    return [p for p in paths if (f := _STAMP.search(PurePosixPath(p).name)) and 0 <= (date(*map(int, f.groups())) - start).days < 7]


def resolved_paths(source_files: list[str] | None, request_target: str | None, exists, default: str | None = None) -> list[str]:
    """Paths of a dataset by precedence: listed files, else the request's target, else its twelve months, else the default.

    ``exists`` tells whether a path is there. The months of a target are named by its stem without a closing year or quarter.
    """
    if source_files:
        return list(source_files)
    if request_target:
        if exists(request_target):
            return [request_target]
        at = PurePosixPath(request_target)
        found = re.search(r"-(\d{4})(?:-q[1-4])?$", at.stem)
        stem, years = (at.stem[: found.start()], [int(found[1])]) if found else (at.stem, range(1980, 2100))
        months = [str(at.with_name(f"{stem}-{y}-{m:02d}{at.suffix}")) for y in years for m in range(1, 13)]
        if there := [p for p in months if exists(p)]:
            return there
    return [default] if default and exists(default) else []


def boxes_meet(a: tuple[float, float, float, float], b: tuple[float, float, float, float]) -> bool:
    """Whether two boxes (west, south, east, north) share a point."""
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def catalog_in_box(rows: list[dict], box: tuple[float, float, float, float]) -> list[dict]:
    """Catalog rows whose ``bbox_if_known`` (JSON list) meets the box; rows without a readable one stay out."""
    out = []
    for r in rows:
        try:
            known = json.loads(r.get("bbox_if_known") or "null")
        except ValueError:
            known = None
        if isinstance(known, list) and len(known) == 4 and boxes_meet(tuple(map(float, known)), box):
            out.append(r)
    return out


def week_directories(names: list[str]) -> dict[date, str]:
    """Weeks by the directories that hold them (week_YYYY_MM_DD); other names are passed over."""
    return {date(*map(int, f.groups())): n for n in sorted(names) if (f := _WEEK.match(PurePosixPath(n).name))}


def has_station_files(names: list[str]) -> bool:
    """Whether a folder holds any station's own file; the inventory alone is none."""
    return any(n.lower().endswith(".csv") and PurePosixPath(n).name.lower() != "stations.csv" for n in names)


def usable_visibility(lines: list[str]) -> bool:
    """Whether any VIS of a station file is a distance below 999999."""
    for row in csv.DictReader(lines):
        found = re.match(r"\d+", row.get("VIS") or "")
        if found and int(found[0]) < 999999:
            return True
    return False
