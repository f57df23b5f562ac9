"""WARC archives: write, read back, and merge the index externally.

Writing: one record per page, as text files whose line separator is the blank
line that ends a WARC record, by Spark's own writer into the shared folder, so
that a lost task is written again. Of pages with equal payloads the one with
the largest id is a response; the others are revisit records (no block; digest,
length and the response's id are in the header).

Reading: a file is a stream of pieces between blank lines; records are cut from
it by Content-Length, so payloads may hold any line ends. Digests of responses
are computed from the payload read and must equal the header's.

Index: every archive yields runs sorted by URL key (host reversed, lower-case)
and timestamp, written to the shared folder. Key ranges are dealt to tasks;
each merges its slices of all runs with a loser tree, so the index is ordered
over all partitions (``position`` ascends with them). Ranges are cut by rows
(about ``RANGE_ROWS``) and their keys end with run and place, so a hot URL, or
one row repeated, spans ranges and a task's memory doesn't grow with the table.
A slice stays in Arrow form; the tree reads it as a sorted iterator.

Null html is an empty payload; a null url gives an empty key; rows with a null
id come first of their group, with one of them the response if no other has an
id; rows that repeat an id with an equal payload are each the response if that
id is the largest. An empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnxml.llm.common import materialise, shared_path

GAP = "\r\n\r\n"
#: Captures without a time of their own count from here, a second per id.
EPOCH = 1_704_067_200
#: Index entries of a locally sorted run.
RUN_ROWS = 50_000
#: Index entries of a merged range: what one task holds.
RANGE_ROWS = 200_000
#: Entries of a run that are decoded at a time.
DECODE = 500


def _digit(h: Column, i: Column) -> Column:
    twenty = F.conv(F.substring(h, 5 * F.floor(i / 4).cast("int") + 1, 5), 16, 10).cast("int")
    five = F.floor(twenty / F.pow(F.lit(32), 3 - i % 4)).cast("int") % 32
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), five + 1, 1)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """(record): the text of each page's record without its closing blank line."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    seconds = F.coalesce(F.col(time_col).cast("timestamp").cast("bigint"), F.lit(EPOCH)) if time_col else F.lit(EPOCH) + F.coalesce(F.col(id_col).cast("bigint"), F.lit(0))
    src = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"),
                       seconds.alias("seconds"), F.sha1(html.cast("binary")).alias("hex"))
    last = src.groupBy("hex").agg(F.max("id").alias("response"))
    # Payloads move by digest and id, so a payload that many pages share has no
    # hot key; revisit records carry no block and are joined without it.
    of = (src["hex"] == last["hex"]) & src["id"].eqNullSafe(last["response"])
    first = src.join(last, of, "left_semi").select("*", F.lit(None).cast("bigint").alias("response"), F.octet_length("html").alias("size"))
    again = (src.select("id", "url", "seconds", "hex", F.octet_length("html").alias("size")).join(last, "hex")
             .where(~F.col("id").eqNullSafe(F.col("response"))))
    return _record(first, False).unionAll(_record(again, True))


def _record(rows: DataFrame, revisit: bool) -> DataFrame:
    """(record) of rows (id, url, seconds, hex, response, size and, of responses, html)."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    size = F.col("size").cast("string")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("revisit" if revisit else "response")),
        line("WARC-Record-ID", urn("id")), line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.concat(F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("hex")))),
        F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                 line("WARC-Refers-To", urn("response")), line("X-Payload-Length", size)) if revisit else F.lit(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.lit("0") if revisit else size))
    return rows.select(F.concat(header, F.lit(GAP), F.lit("") if revisit else F.col("html")).alias("record"))


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _digit(hexed, i)), "")


def write(pages: DataFrame, path: str, **columns: str) -> None:
    records(pages, **columns).write.option("lineSep", GAP).option("compression", "gzip").text(path)


_FIELD = re.compile(r"^([^:\r\n]+): ?([^\r\n]*)", re.M)


def cut_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records in a stream of pieces, each of
    which a blank line ends."""
    gap, header, parts, have, need = GAP.encode(), None, [], 0, 0
    for piece in pieces:
        if header is None:
            piece = piece.lstrip(b"\r\n")
            if not piece:
                continue
            header = dict(_FIELD.findall(piece.decode("utf-8", "surrogatepass")))
            need, parts, have = int(header["Content-Length"]), [], 0
            if need:
                continue
        else:
            parts += [piece, gap]
            have += len(piece) + len(gap)
        if have >= need:
            block = b"".join(parts)[:need]
            yield header, block
            header, parts = None, []
    if header is not None:
        raise ValueError(f"cut short: {header.get('WARC-Record-ID')}")


def url_key(url: str) -> str:
    """Sort-friendly key: host reversed, then path and query, all lower-case."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


ENTRY = "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in ENTRY.split(", ")]


def _urn(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _entry(header: dict[str, str], block: bytes) -> tuple:
    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = header["WARC-Type"] == "revisit"
    if not revisit and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError(f"digest differs: {header['WARC-Record-ID']}")
    return (url_key(header["WARC-Target-URI"]), header["WARC-Date"], _urn(header["WARC-Record-ID"]),
            int(header["X-Payload-Length"]) if revisit else len(block), digest, header["WARC-Type"], _urn(header.get("WARC-Refers-To")))


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


def _batch(entries: list[tuple], extra: list[tuple[str, list]] = []) -> pa.RecordBatch:  # noqa: B006
    cols = [pa.array([e[i] for e in entries], t) for i, t in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays(cols + [pa.array(v, pa.int64()) for _, v in extra], _NAMES + [n for n, _ in extra])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records under ``path``, in locally sorted runs:
    (entry..., run, place)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=_order)
            return _batch(held, [("run", [run] * len(held)), ("place", list(range(len(held))))])

        pieces = (p.as_py().encode("utf-8", "surrogatepass") for b in batches for p in b.column(0))
        for header, block in cut_records(pieces):
            held.append(_entry(header, block))
            if len(held) >= RUN_ROWS:
                yield flush()
                held, run = [], run + 1
        if held:
            yield flush()

    return spark.read.option("lineSep", GAP).schema("value string").text(path).mapInArrow(each, ENTRY + ", run bigint, place bigint")


class LoserTree:
    """k sorted sequences merged with one comparison per level and entry; of
    each one entry is held."""

    def __init__(self, runs: Iterable[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head: list[tuple | None] = [None] * self.k
        self.keys: list[tuple] = [()] * self.k
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self.advance(i)
            self.play(i)

    def advance(self, i: int) -> None:
        """An ended run loses to all others; ties go to the earlier run."""
        entry = self.head[i] = next(self.runs[i], None)
        self.keys[i] = (True, (), i) if entry is None else (False, _order(entry), i)

    def play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.loser[node]
            if other < 0:  # still being built: wait here
                self.loser[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.loser[0]
            if self.head[i] is None:
                return
            yield self.head[i]
            self.advance(i)
            self.play(i)


def _entries(slices: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The entries of one run, decoded a few at a time."""
    for part in slices:
        for at in range(0, part.num_rows, DECODE):
            yield from zip(*(c.to_pylist() for c in part.slice(at, DECODE).columns))


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The globally ordered index: (entry..., position)."""
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:  # sorted by run and place
            run = b.column(7).to_numpy()
            cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    slices.setdefault(int(run[lo]), []).append(b.select(_NAMES).slice(lo, hi - lo))
        out = []
        for entry in LoserTree(_entries(slices[r]) for r in sorted(slices)):
            out.append(entry)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    dealt = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first(), "run", "place").sortWithinPartitions("run", "place")
    return dealt.mapInArrow(each, ENTRY).withColumn("position", F.monotonically_increasing_id())


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back and return the merged index:
    one row per page."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, time_col=time_col)
    index = merge_runs(materialise(read_runs(spark, path), "runs"))
    return index.withColumnRenamed("page_id", id_col)
