"""Zipped feeds: what the archive holds, and its tables as DataFrames.

The driver only reads the archive's directory.  Members are decoded by a
Python data source, one partition a member, into (csv_row, fields); everything
after that is expressions.
"""

from __future__ import annotations

import csv
import io
import json
import os
import stat
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import replace
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import notices as N
from .. import spec
from ..feed import ROW, Feed

csv.field_size_limit(1 << 30)

#: Members up to this size are decoded where the archive's directory is read.
LOCAL_BYTES = 1 << 20


#: What reading a damaged or locked member raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError)


def _records(raw: io.BufferedIOBase) -> Iterator[tuple[list[str], str | None]]:
    """CSV records, each with what is wrong with it as CSV; bytes that aren't
    UTF-8 become U+FFFD, blank lines don't count."""
    reader = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
    while True:
        try:
            record = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            yield [], str(e)
            continue
        if record:
            yield record, None


class _Member(InputPartition):
    def __init__(self, path: str, member: str) -> None:
        self.path, self.member = path, member


class FeedTableReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.members = options["path"], json.loads(options["members"])
        self.most, self.check = int(options.get("max_rows", "20000000")), options.get("check") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Member(self.path, m) for m in self.members]

    def read(self, partition: _Member) -> Iterator[tuple[str, int, list[str], str | None]]:
        if self.check:
            yield from self._damage(partition)
            return
        with zipfile.ZipFile(partition.path) as z, z.open(partition.member) as raw:
            for k, (fields, fault) in enumerate(_records(raw), 1):
                if k > self.most + 2:  # one record past the limit shows that there are more
                    return
                yield partition.member, k, fields, fault

    def _damage(self, partition: _Member) -> Iterator[tuple[str, int, list[str], str | None]]:
        """One row if the member can't be read to its end."""
        try:
            with zipfile.ZipFile(partition.path) as z, z.open(partition.member) as raw:
                while raw.read(1 << 20):
                    pass
        except UNREADABLE as e:
            yield partition.member, 0, [], str(e)


class FeedTableSource(DataSource):
    """``spark.read.format("tramline_feed")``: options path, members (JSON list),
    max_rows, and check=true for only the members that can't be read."""

    @classmethod
    def name(cls) -> str:
        return "tramline_feed"

    def schema(self) -> str:
        return "member string, csv_row bigint, fields array<string>, fault string"

    def reader(self, schema: StructType) -> FeedTableReader:
        return FeedTableReader(self.options)


def safe_name(name: str) -> bool:
    """True for members that stay inside the folder they are unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith("/") and name[1:2] != ":" and all(p not in ("", ".", "..") for p in parts)


def _is_link(info: zipfile.ZipInfo) -> bool:
    return stat.S_ISLNK(info.external_attr >> 16)


def listing(path: str, budgets: spec.Budgets) -> tuple[dict[str, zipfile.ZipInfo], set[str], list[tuple]]:
    """(tables to read, files present, notices) from the archive's directory."""
    try:
        with zipfile.ZipFile(path) as z:
            infos = z.infolist()
    except (zipfile.BadZipFile, OSError) as e:
        raise OSError(f"{path}: not a readable feed archive: {e}") from e
    if len(infos) > budgets.max_members:
        raise OSError(f"{path}: more than {budgets.max_members} members")
    times = Counter(i.filename for i in infos)
    found: dict[str, zipfile.ZipInfo] = {}
    present: set[str] = set()
    out: list[tuple] = []
    total = 0
    for name in dict.fromkeys(i.filename for i in infos):
        info = next(i for i in infos if i.filename == name)
        if info.is_dir():
            continue
        base = name.rpartition("/")[2]
        if "/" in name:
            if base in spec.FILES:
                out.append((name, "invalid_input_files_in_subfolder", N.ERROR, None, {"filename": name}))
        elif name not in spec.FILES:
            if name != spec.UNPARSED:
                out.append((name, "unknown_file", N.INFO, None, {"filename": name}))
        elif times[name] > 1:
            present.add(name)
            out.append((name, "duplicate_zip_entry", N.ERROR, None, {"filename": name}))
        else:
            present.add(name)
            total += info.file_size
            if info.file_size > budgets.max_entry_bytes or total > budgets.max_total_bytes:
                out.append((name, "unreadable_file", N.ERROR, None, {"filename": name, "message": "the member exceeds the size budget"}))
                continue
            found[name] = info
    return found, present, out


def _header(path: str, name: str, budgets: spec.Budgets) -> tuple[list[str] | None, tuple[str, str] | None]:
    """(header, why the table is refused)."""
    try:
        with zipfile.ZipFile(path) as z:
            with z.open(name) as raw:
                head = raw.read(1 << 20).split(b"\n", 1)[0]
                if not head.strip(b"\xef\xbb\xbf\r\n"):
                    return None, ("empty_file", "")
                if head.count(b",") > max(4 * budgets.max_columns, 4096):
                    return None, ("unreadable_file", "the header has too many delimiters")
            with z.open(name) as raw:
                header, fault = next(_records(raw), (None, None))
    except UNREADABLE as e:
        return None, ("unreadable_file", str(e))
    if fault is not None:
        return None, ("csv_parsing_failed", fault)
    if header is None:
        return None, ("empty_file", "")
    if len(header) > budgets.max_columns:
        return None, ("unreadable_file", "the header has too many columns")
    return header, None


def _raw(spark: SparkSession, path: str, info: zipfile.ZipInfo, budgets: spec.Budgets) -> DataFrame:
    """(csv_row, fields) of a member: by the data source, or, for one of at most
    ``LOCAL_BYTES``, as a local relation, which costs no task and whose size joins know."""
    if info.file_size > LOCAL_BYTES:
        return spark.read.format("tramline_feed").options(path=path, members=json.dumps([info.filename]), max_rows=str(budgets.max_rows)).load().drop("member")
    with zipfile.ZipFile(path) as z, z.open(info.filename) as raw:
        records = list(islice(_records(raw), budgets.max_rows + 2))
    return spark.createDataFrame(
        pa.table({ROW: pa.array(range(1, len(records) + 1), pa.int64()), "fields": pa.array([f for f, _ in records], pa.list_(pa.string())), "fault": pa.array([e for _, e in records], pa.string())})
    )


def damaged(spark: SparkSession, path: str, found: Mapping[str, zipfile.ZipInfo]) -> dict[str, str]:
    """Why members can't be read to their end; large ones are looked at in tasks."""
    out: dict[str, str] = {}
    large = sorted(n for n, info in found.items() if info.file_size > LOCAL_BYTES)
    if large:
        out |= {r.member: r.fault for r in spark.read.format("tramline_feed").options(path=path, members=json.dumps(large), check="true").load().collect()}
    for name in set(found) - set(large):
        try:
            with zipfile.ZipFile(path) as z:
                z.read(name)
        except UNREADABLE as e:
            out[name] = str(e)
    return out


def header_notices(name: str, header: list[str]) -> list[tuple]:
    """What is wrong with the header cells."""
    out: list[tuple] = []
    if any("�" in h for h in header):
        out.append((name, "invalid_character", N.ERROR, 1, {"filename": name, "csvRowNumber": "1"}))
    seen: set[str] = set()
    for h in header:
        if not h:
            out.append((name, "empty_column_name", N.WARNING, None, {"filename": name}))
            continue
        if h.strip() != h:
            out.append((name, "leading_or_trailing_whitespaces", N.WARNING, 1, {"filename": name, "csvRowNumber": "1", "fieldValue": h[:120]}))
        if h in seen:
            out.append((name, "duplicated_column", N.ERROR, None, {"filename": name, "fieldName": h[:120]}))
        seen.add(h)
    out += [(name, "missing_required_column", N.ERROR, None, {"filename": name, "fieldName": c}) for c in spec.FILES[name].columns if c not in seen]
    return out


def stored_names(header: list[str]) -> list[str]:
    """Column names for a header: the first of a name has it, others a number."""
    taken: set[str] = {ROW}
    out = []
    for k, h in enumerate(header):
        name = h if h and h.lower() not in {t.lower() for t in taken} else f"{h}#{k + 1}"
        taken.add(name)
        out.append(name)
    return out


def shaped(raw: DataFrame, name: str, header: list[str], budgets: spec.Budgets) -> tuple[DataFrame, DataFrame]:
    """(table, notices of its rows) from raw records; the header is record 1."""
    body = raw.where((F.col(ROW) > 1) & (F.col(ROW) <= budgets.max_rows + 1))
    at, width = F.col(ROW), F.size("fields")
    long = width != len(header)
    blank = F.forall("fields", lambda f: F.regexp_replace(f, r"(?U)^\s+|\s+$", "") == "")
    odd = F.exists("fields", lambda f: F.instr(f, "�") > 0)
    body, faulty = body.where("fault is null"), body.where("fault is not null")
    found = [
        F.when(long, N.notice("invalid_row_length", N.ERROR, filename=name, csvRowNumber=at, rowLength=width, headerCount=F.lit(len(header)))),
        F.when(~long & blank, N.notice("empty_row", N.WARNING, place=1, filename=name, csvRowNumber=at)),
        F.when(~long & ~blank & odd, N.notice("invalid_character", N.ERROR, place=2, filename=name, csvRowNumber=at)),
    ]
    table = body.where(~long & ~blank & ~odd).select(ROW, *[F.col("fields")[k].alias(c) for k, c in enumerate(stored_names(header))])
    failed = N.notice("csv_parsing_failed", N.ERROR, filename=name, csvRowNumber=at, message=F.col("fault"))
    return table, N.emit(body, found, stage="read", file=name, number=1).unionAll(N.emit(faulty, [failed], stage="read", file=name, number=1))


def feed_level(feed: Feed, counts: Mapping[str, int]) -> list[tuple]:
    """What the feed as a whole lacks."""
    present = feed.present if feed.present is not None else frozenset(feed.tables)
    out: list[tuple] = [(n, "missing_required_file", N.ERROR, None, {"filename": n}) for n, f in spec.FILES.items() if f.required and n not in present]
    if not present & set(spec.CALENDARS):
        out.append(("calendar.txt", "missing_calendar_and_calendar_date_files", N.ERROR, None, {}))
    if "feed_info.txt" not in present:
        out.append(("feed_info.txt", "missing_recommended_file", N.WARNING, None, {"filename": "feed_info.txt"}))
    elif counts.get("feed_info.txt", 0) > 1:
        out.append(("feed_info.txt", "more_than_one_entity", N.ERROR, None, {"filename": "feed_info.txt", "entityCount": str(counts["feed_info.txt"])}))
    return out


def read(spark: SparkSession, path: str, budgets: spec.Budgets | None = None) -> Feed:
    """The feed of an archive, with the structural notices of reading it."""
    budgets = budgets or spec.Budgets()
    spark.dataSource.register(FeedTableSource)
    found, present, out = listing(path, budgets)
    incomplete = {f for f, code, *_ in out if code in ("duplicate_zip_entry", "unreadable_file")}
    tables, headers, rows = {}, {}, []
    lost = damaged(spark, path, found)
    for name, why in sorted(lost.items()):
        out.append((name, "unreadable_file", N.ERROR, None, {"filename": name, "message": why}))
        incomplete.add(name)
    for name in sorted(set(found) - set(lost)):
        header, refused = _header(path, name, budgets)
        if header is None:
            out.append((name, refused[0], N.ERROR, None, {"filename": name} | ({"message": refused[1]} if refused[1] else {})))
            incomplete |= {name} if refused[0] in ("unreadable_file", "csv_parsing_failed") else set()
            continue
        out += header_notices(name, header)
        raw = _raw(spark, path, found[name], budgets)
        tables[name], row_notices = shaped(raw, name, header, budgets)
        headers[name] = tuple(header)
        rows.append(row_notices)
    feed = Feed(tables, headers, frozenset(incomplete), frozenset(present)).cached()
    counts = feed.row_counts()
    sizes = {n: _records_beyond(path, n, budgets.max_rows) for n in feed.tables if counts.get(n, 0) >= budgets.max_rows}
    for name, beyond in sizes.items():
        if beyond:
            out.append((name, "too_many_rows", N.ERROR, None, {"filename": name, "rowNumber": str(budgets.max_rows + 2)}))
            incomplete.add(name)
    for name in sorted(set(feed.tables) - set(counts)):
        out.append((name, "empty_file", N.ERROR, None, {"filename": name}))
    out += feed_level(feed, counts)
    kept = {n: t for n, t in feed.tables.items() if n in counts}
    notices = N.union([N.constant(spark, out, number=0), *rows] if out else rows, spark)
    return replace(feed, tables=kept, headers={n: h for n, h in headers.items() if n in kept}, incomplete=frozenset(incomplete), notices=notices)


def _records_beyond(path: str, name: str, most: int) -> bool:
    with zipfile.ZipFile(path) as z, z.open(name) as raw:
        return any(k > most + 1 for k, _ in enumerate(_records(raw), 1))


def extras(path: str) -> dict[str, bytes]:
    """Members that are no parsed tables, as they are, without unsafe names, links and repeats."""
    out: dict[str, bytes] = {}
    taken = {n.lower() for n in spec.FILES}
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            name = info.filename
            if info.is_dir() or _is_link(info) or not safe_name(name) or name.lower() in taken or name in out:
                continue
            out[name] = z.read(info)
    return out


def write(feed: Feed, path: str, *, source: str | None = None, keep: Mapping[str, bytes] | None = None) -> None:
    """Write the feed as an archive: tables by name, rows in order, RFC 4180 quoting.

    The archive is staged beside its place and moved there when whole; a link,
    or the source itself under another name, is refused.
    """
    if os.path.islink(path):
        raise OSError(f"{path} is a symbolic link")
    if source is not None and os.path.exists(path) and os.path.samefile(path, source):
        raise OSError(f"{path} is the source itself")
    staging = f"{path}.part"
    if os.path.islink(staging):
        raise OSError(f"{staging} is a symbolic link")
    with zipfile.ZipFile(staging, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(feed.tables):
            table = feed.tables[name]
            stored = [c for c in table.columns if c != ROW]
            with z.open(name, "w", force_zip64=True) as raw:
                text = io.TextIOWrapper(raw, encoding="utf-8", newline="")
                out = csv.writer(text, lineterminator="\n")
                out.writerow(feed.headers.get(name, tuple(stored)))
                # One partition at a time: an archive is written by one process.
                for row in table.orderBy(ROW).select(*[F.col(f"`{c}`") for c in stored]).toLocalIterator():
                    out.writerow(["" if v is None else v for v in row])
                text.flush()
                text.detach()
        for name, data in (keep if keep is not None else feed.extras).items():
            z.writestr(name, data)
    os.replace(staging, path)
