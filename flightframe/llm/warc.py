"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Every response gives one metadata record (application/warc-fields) and one conversion record (text/plain).  Both name
the response in WARC-Refers-To and each other in WARC-Concurrent-To, and keep the response's target and date; the
metadata record preserves the source's HTTP headers and payload digest.  Digests are sha1 in base 32, as is usual in WARC
files; a derived record's payload is its block.  Record ids are name-based, so a second run gives the same records.

Text is what HTML's tokens leave: tags end where attribute values in quotes allow, comments and hidden elements go (an
unclosed head, noscript or template hides nothing; an unclosed script or style, comment or tag reaches to the end of the
page), all character references are resolved, white space becomes single spaces, and elements that begin or end a line
make line ends.  The time grows with the length of a page, whatever is in it.

Null payloads count as empty, null targets leave out the target line, null headers give no source lines.  Repeated
responses give repeated records; extra columns are left out; an empty table gives no records.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import schema_with, table, text_slices

#: Bytes of pages that are converted at once.
SLICE = 1 << 20

CRLF = "\r\n"

#: Elements that hold no text (two of them no elements either), and elements that begin or end a line.
RAW, HIDDEN = {"script", "style"}, {"head", "noscript", "template"}
LINE_ELEMENTS = set("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

#: A tag's name; the rest of a tag: values in quotes hide its end.
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+>""")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW}
_WHITE, _LINES = re.compile(r"[ \t\r\n\f]+"), re.compile(r" ?\n[ \n]*")


def html_tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", characters), ("start", name) and ("end", name) in order; comments and the text of scripts are left out."""
    at = 0
    while (i := page.find("<", at)) >= 0:
        if i > at:
            yield "text", page[at:i]
        if name := _NAME.match(page, i + 1):
            rest = _REST.match(page, name.end())
            if not rest:
                return
            kind, word, at = "end" if page[i + 1] == "/" else "start", name[1].lower(), rest.end()
            yield kind, word
            if kind == "start" and word in RAW:
                end = _RAW_END[word].search(page, at)
                if not end:
                    return
                at = end.start()
        elif page.startswith(("<!", "<?", "</"), i):
            comment = page.startswith("<!--", i)
            mark = "-->" if comment and not page.startswith((">", "->"), i + 4) else ">"
            end = page.find(mark, i + 4 if comment else i + 2)
            if end < 0:
                return
            at = end + len(mark)
        else:
            yield "text", "<"
            at = i + 1
    yield "text", page[at:]


def page_text(page: str) -> str:
    """The text of a page, one line per block of text."""
    tokens = list(html_tokens(page))
    last = {word: k for k, (kind, word) in enumerate(tokens) if kind == "end" and word in HIDDEN}
    parts, hidden = [], ""
    for k, (kind, word) in enumerate(tokens):
        if hidden:
            hidden = "" if kind == "end" and word == hidden else hidden
        elif kind == "text":
            parts.append(_WHITE.sub(" ", html.unescape(word) if "&" in word else word))
        elif word in HIDDEN and kind == "start" and last.get(word, -1) > k:
            hidden = word
        elif word in LINE_ELEMENTS:
            parts.append("\n")
    return _LINES.sub("\n", re.sub(" {2,}", " ", "".join(parts))).strip(" \n")


def with_text(responses: DataFrame) -> DataFrame:
    """responses(.., payload) with text string in place of payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch, "payload", SLICE):
                texts = pa.array([page_text(p or "") for p in part.column("payload").to_pylist()], pa.string())
                rest = [c for c in part.schema.names if c != "payload"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), texts], [*rest, "text"])

    return responses.mapInArrow(run, schema_with(responses.drop("payload"), text="string"))


def digest(text: Column) -> Column:
    """sha1 in base 32 with its label: 5 hexadecimal digits at a time become 4 digits of base 32."""
    code = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(code, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def record_id(kind: str, *names: Column) -> Column:
    """A name-based identifier (version 3 layout over an MD5 of the names)."""
    code = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(n.cast("string"), F.lit("")) for n in names)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(code, 1, 8), F.lit("-"), F.substring(code, 9, 4), F.lit("-3"), F.substring(code, 14, 3), F.lit("-a"), F.substring(code, 18, 3), F.lit("-"), F.substring(code, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks inside a value would end the header, so they are spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), CRLF, "  "), F.lit(CRLF)), F.lit(""))


def derivatives(responses: DataFrame) -> DataFrame:
    """responses(record_id, target_uri, date, http_header, payload; strings) -> one row per derived record.

    (refers_to, target_uri, warc_date, warc_type, record_id, concurrent_to, content_type, content_length long,
    block_digest, payload_digest, source_digest, block): http_header has the status line and headers, separated by CRLF.
    """
    payload = F.coalesce("payload", F.lit(""))
    base = with_text(
        responses.select(
            F.col("record_id").alias("refers_to"),
            "target_uri",
            F.col("date").alias("warc_date"),
            F.coalesce("http_header", F.lit("")).alias("http"),
            digest(payload).alias("source_digest"),
            F.octet_length(payload).cast("long").alias("source_length"),
            "payload",
        )
    )
    lines = F.filter(F.split("http", CRLF), lambda x: x.contains(":"))
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    fields = F.concat(
        _line("source-status", F.when(status != "", status)),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-header-"), x, F.lit(CRLF))), ""),
        _line("source-payload-digest", F.col("source_digest")),
        _line("source-payload-length", F.col("source_length")),
        _line("conversion-length", F.octet_length("text")),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = base.select("refers_to", "target_uri", "warc_date", "source_digest", F.inline(kinds))
    ids = {kind: record_id(kind, F.col("refers_to")) for kind in ("metadata", "conversion")}
    block_digest = digest(F.col("block"))
    return rows.select(
        "*",
        F.when(F.col("warc_type") == "metadata", ids["metadata"]).otherwise(ids["conversion"]).alias("record_id"),
        F.when(F.col("warc_type") == "metadata", ids["conversion"]).otherwise(ids["metadata"]).alias("concurrent_to"),
        F.octet_length("block").cast("long").alias("content_length"),
        block_digest.alias("block_digest"),
        block_digest.alias("payload_digest"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """records plus header string: the WARC header that precedes the block."""
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("warc_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Concurrent-To", F.col("concurrent_to")),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Date", F.col("warc_date")),
        _line("WARC-Block-Digest", F.col("block_digest")),
        _line("WARC-Payload-Digest", F.col("payload_digest")),
        _line("Content-Type", F.col("content_type")),
        _line("Content-Length", F.col("content_length")),
        F.lit(CRLF),
    )
    return records.withColumn("header", header)


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one per partition: a record is header and block, and two line ends close it."""
    serialised(records).select(F.concat("header", "block").alias("value")).write.option("lineSep", CRLF * 2).text(path)


#: The capture date and HTTP header of the pages table, which has neither.
CAPTURED = "2024-01-01T00:00:00Z"
SERVER_HEADER = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Server: crawl-fixture"


def page_responses(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as response records."""
    return pages.select(record_id("response", F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(CAPTURED).alias("date"), F.lit(SERVER_HEADER).alias("http_header"), F.col("html").alias("payload"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialised(derivatives(page_responses(table(spark, sf_dir, "pages"))))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Patterns for the text of pages as they are in the pages table: comments between elements, no end of a tag in a value
#: in quotes, and references of these names only.
_W = r"[ \t\r\n\f]"
_SQL_STEPS = [
    (r"(?is)<(?:!--.*?--|" + "|".join(rf"{e}\b[^>]*>.*?</{e}{_W}*" for e in sorted(RAW | HIDDEN)) + ")>", " "),
    (_W + r"*[\t\r\n\f]" + _W + "*| {2,}", " "),
    (r"(?i)</?(?:" + "|".join(sorted(LINE_ELEMENTS)) + r")\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
]
_SQL_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def _sql_text(page: str) -> str:
    for pattern, put in _SQL_STEPS:
        page = f"regexp_replace({page}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    for name, put in _SQL_REFERENCES.items():
        page = f"replace({page}, {_quoted(name)}, {_quoted(put)})"
    return f"trim(regexp_replace({page}, ' *\n[ \n]*', '\n', 'g'), ' ' || chr(10))"


_SQL_DIGEST = "'sha1:' || translate(" + " || ".join(f"to_base(('0x' || substr(sha1(x), {5 * k + 1}, 5))::bigint, 32, 4)" for k in range(8)) + ", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

def _sql_digest(x: str) -> str:
    return _SQL_DIGEST.replace("(x)", f"({x})")


def _sql_id(x: str) -> str:
    code = f"md5({x})"
    return f"'<urn:uuid:' || substr({code}, 1, 8) || '-' || substr({code}, 9, 4) || '-3' || substr({code}, 14, 3) || '-a' || substr({code}, 18, 3) || '-' || substr({code}, 21, 12) || '>'"


_END = "chr(13) || chr(10)"
OP4_SQL = f"""
with base as (
    select {_sql_id("'response|' || coalesce(page_id::varchar, '') || '|' || coalesce(url, '')")} as refers_to, url as target_uri,
        {_sql_digest("coalesce(html, '')")} as source_digest, strlen(coalesce(html, '')) as source_length, {_sql_text("coalesce(html, '')")} as text
    from pages),
records as (
    select refers_to, target_uri, source_digest, 'metadata' as warc_type, 'application/warc-fields' as content_type,
        'source-status: 200' || {_END} || 'source-header-Content-Type: text/html; charset=utf-8' || {_END} || 'source-header-Server: crawl-fixture' || {_END}
        || 'source-payload-digest: ' || source_digest || {_END} || 'source-payload-length: ' || source_length || {_END} || 'conversion-length: ' || strlen(text) || {_END} as block
    from base
    union all
    select refers_to, target_uri, source_digest, 'conversion', 'text/plain; charset=utf-8', text from base),
named as (
    select *, '{CAPTURED}' as warc_date, {_sql_id("warc_type || '|' || refers_to")} as record_id, {_sql_id("case warc_type when 'metadata' then 'conversion' else 'metadata' end || '|' || refers_to")} as concurrent_to,
        strlen(block) as content_length, {_sql_digest('block')} as block_digest, {_sql_digest('block')} as payload_digest
    from records)
select *, 'WARC/1.1' || {_END} || 'WARC-Type: ' || warc_type || {_END} || 'WARC-Record-ID: ' || record_id || {_END} || 'WARC-Refers-To: ' || refers_to || {_END} || 'WARC-Concurrent-To: ' || concurrent_to || {_END}
    || coalesce('WARC-Target-URI: ' || replace(replace(target_uri, chr(13), ' '), chr(10), ' ') || {_END}, '') || 'WARC-Date: ' || warc_date || {_END} || 'WARC-Block-Digest: ' || block_digest || {_END} || 'WARC-Payload-Digest: ' || payload_digest || {_END}
    || 'Content-Type: ' || content_type || {_END} || 'Content-Length: ' || content_length || {_END} || {_END} as header
from named
"""
