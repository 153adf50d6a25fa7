"""Which files a dataset has for a period: climate files by precedence, flood rasters and flood depths by week.

Names are decided on the driver, as there are as many as files; rasters are opened in tasks, each only in the blocks that a box meets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import geotiff
from .weeks import catalog_in_box, month_list, stamped_in_week

_WINDOW = re.compile(r"weekly window (\d{4})-(\d{2})-(\d{2})\.\.")
#: Names of merged climate files whose months can stand in for them; the first group is the place.
_MERGED = (re.compile(r"era5-land-hourly-([a-z0-9-]+)-\d{4}-(?:q\d|[a-z0-9_-]+)\.nc"), re.compile(r"era5-land-([a-z0-9-]+)\.nc"))


def _day(text, other: date) -> date:
    return text if isinstance(text, date) else date.fromisoformat(str(text)) if text else other


def climate_files(folder: str, config: dict, first: date, last: date, exists: Callable[[str], bool]) -> list[str]:
    """Files of a period by precedence: listed files, else those of listed requests, else one for each day or week, else the merged file, else its months.

    ``config`` has ``source_files``; ``requests`` (dicts with ``target_filename``); ``split_request_by`` daily or weekly with ``request``, ``target_prefix``, step and dates of its
    own; or ``target_filename``. Months stand in for a merged file that is not there only if those of the whole period are; else the merged name
    is returned, for the reader to miss. Nothing configured: none.
    """
    named = [str(n).strip() for n in config.get("source_files") or [] if str(n).strip()] if isinstance(config.get("source_files"), list) else []
    if named:
        return [f"{folder}/{n}" for n in named]
    requests = config.get("requests")
    if isinstance(requests, list) and requests:
        targets = [str(r.get("target_filename") or "").strip() for r in requests if isinstance(r, dict)]
        return [f"{folder}/{t}" for t in targets if t]
    split = str(config.get("split_request_by") or "").strip().lower()
    if split in ("daily", "weekly"):
        request = config.get("request")
        if not request:
            raise ValueError(f"a {split} split needs a request")
        step = int(config.get("request_step_days") or config.get("step_days") or (1 if split == "daily" else 7))
        begin, end = max(first, _day(config.get("start_date"), first)), min(last, _day(config.get("end_date"), last))
        if end < begin:
            raise ValueError(f"files from {config.get('start_date')} to {config.get('end_date')} have no day of {first} to {last}")
        suffix = "grib" if "grib" in str(request.get("data_format") or request.get("format") or "netcdf").lower() else "nc"
        prefix = str(config.get("target_prefix") or "era5").strip() or "era5"
        return [f"{folder}/{prefix}-{begin + timedelta(days=k)}.{suffix}" for k in range(0, (end - begin).days + 1, step)]
    target = str(config.get("target_filename") or "").strip()
    if not target:
        return []
    if exists(f"{folder}/{target}"):
        return [f"{folder}/{target}"]
    place = next((m[1] for p in _MERGED if (m := p.fullmatch(target.lower()))), None)
    months = [f"{folder}/era5-land-hourly-{place}-{y:04d}-{m:02d}.nc" for y, m in month_list(first, last)] if place else []
    return months if months and all(map(exists, months)) else [f"{folder}/{target}"]


def _meets(raster: geotiff.Raster, box: tuple[float, float, float, float]) -> tuple[int, int, int, int] | None:
    """Rows and columns (first, behind the last) of a geographic raster that a box (west, south, east, north) meets."""
    top, bottom = (raster.top - box[3]) / raster.cell[1], (raster.top - box[1]) / raster.cell[1]
    left, right = (box[0] - raster.left) / raster.cell[0], (box[2] - raster.left) / raster.cell[0]
    rows, cols = (max(0, int(np.floor(top))), min(raster.height, int(np.ceil(bottom)))), (max(0, int(np.floor(left))), min(raster.width, int(np.ceil(right))))
    return (*rows, *cols) if rows[0] < rows[1] and cols[0] < cols[1] else None


def has_positive(path: str, box: tuple[float, float, float, float]) -> bool:
    """Whether a raster has a value above 0, not missing, in a box; false for a file that cannot be read or is not geographic. Reading ends with the first block that has one."""
    try:
        raster = geotiff.header_of(path)
        found = _meets(raster, box) if raster.epsg == 4326 else None
        if found is None:
            return False
        r0, r1, c0, c1 = found
        high, wide = raster.block
        for y in range(r0 // high, (r1 - 1) // high + 1):
            for x in range(c0 // wide, (c1 - 1) // wide + 1):
                values = geotiff.read_block(raster, y * raster.across + x)
                own = values[max(0, r0 - y * high) : r1 - y * high, max(0, c0 - x * wide) : c1 - x * wide]
                if ((own > 0) & np.isfinite(own) & (own != raster.nodata if raster.nodata is not None else True)).any():
                    return True
    except (OSError, ValueError, KeyError):
        pass
    return False


def positive_rasters(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """Rows (path) of the rasters that have a positive value in a box; each is read by one task, up to the first such block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([p for p in batch.column(0).to_pylist() if has_positive(p, box)], pa.string())], ["path"])

    table = spark.createDataFrame([(p,) for p in paths], "path string")
    return table.repartition(max(1, min(len(paths), 4096)), "path").mapInArrow(run, "path string")


def flood_files(spark: SparkSession, there: list[str], weeks: list[date], catalog: list[dict] | None = None, box: tuple[float, float, float, float] | None = None) -> dict[date, list[str]]:
    """Flood rasters of each week, from the catalog's notes (``weekly window YYYY-MM-DD..``), else from the stamps of their names.

    ``there`` are the paths that exist, ``catalog`` rows with dataset_name, local_path, notes and perhaps bbox_if_known, None if there is no catalog. With a box only
    rows whose own box meets it count, and of these only rasters with a positive value in it. Names decide if there is no catalog, or if it names no file for
    these weeks and no box is asked for.
    """
    by_week: dict[date, list[str]] = {w: [] for w in weeks}
    if catalog is not None:
        if missing := {"dataset_name", "local_path", "notes"} - set().union(*catalog) if catalog else set():
            raise ValueError(f"the catalog lacks {', '.join(sorted(missing))}")
        rows = [r for r in catalog if r["dataset_name"] == "flood"]
        if box is not None and rows and any("bbox_if_known" in r for r in rows):
            rows = catalog_in_box(rows, box)
        rows = [r for r in rows if r["local_path"] in set(there)]
        if box is not None:
            wet = {r["path"] for r in positive_rasters(spark, sorted({r["local_path"] for r in rows}), box).collect()}  # names of files
            rows = [r for r in rows if r["local_path"] in wet]
        for r in rows:
            if found := _WINDOW.search(str(r["notes"])):
                if (week := date(*map(int, found.groups()))) in by_week:
                    by_week[week].append(r["local_path"])
        if box is not None or any(by_week.values()):
            return by_week
    return {w: stamped_in_week(sorted(there), w) for w in weeks}


def flood_depth_files(there: list[str], weeks: list[date]) -> dict[date, list[str]]:
    """Flood depth rasters of each week: those named static or scenario for every week, others if their name has the week's date, with dashes or underscores."""
    names = sorted(p for p in there if p.endswith(".tif"))
    every = [p for p in names if re.search("static|scenario", PurePosixPath(p).name)]
    dated = lambda w: [p for p in names if w.isoformat() in PurePosixPath(p).stem or w.isoformat().replace("-", "_") in PurePosixPath(p).stem]
    return {w: sorted({*every, *dated(w)}) for w in weeks}
