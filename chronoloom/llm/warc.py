r"""WARC derivatives: linked metadata and plain-text conversion records made from response records.

``response_records`` writes WARC/1.1 response records of fetched pages. ``derive`` parses such records (header fields, block
by its Content-Length, HTTP head and payload) and makes two records of each: ``metadata`` (application/warc-fields: what the
HTTP head and the page say of themselves) and ``conversion`` (text/plain). Both keep the source's identifier in
WARC-Refers-To, its target URI and date, and carry its block and payload digests on; the payload digest is computed again and
compared. Every header of the HTTP head is carried into the metadata. Everything is per row: no exchange, no Python.

Defined results: a null html is an empty payload, a null url an empty target; repeated rows give records with the same
identifiers; an empty table gives no records; a record without header end or length has an empty block and fails
``digest_ok``; an HTTP head may end its lines with a bare line feed; a body sent in chunks is put together (an unfinished last chunk as far
as it goes), a compressed one (Content-Encoding other than identity) is not read: its conversion is empty and the metadata say so in
``sourceEncoding``; records may be strings or bytes, bytes that are no UTF-8 are read as the charset that the HTTP head names (ISO-8859-1
and its kin) or with replacement characters; other columns are carried unless they clash with the result's.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import let

WARC_DATE = "2024-01-01T00:00:00Z"
CRLF, GAP = "\r\n", "\r\n\r\n"

# HTML elements that begin a new line of text, elements without text, and named character references.
BLOCK_TAGS = "address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
SILENT_TAGS = ("script", "style", "noscript", "template")
NAMED = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "ntilde": "ñ", "euro": "€",
}

#: All references of HTML that end in a semicolon, and the numbers that stand for characters of Windows-1252.
EVERY_NAME = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
WINDOWS = {n: c for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "ignore"))}

# The rest of a tag: a quote opens a value only after "=", and a value may hold ">".
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
_SILENT = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{t}\b{_REST}.*?(?:</{t}\s*>|\z)" for t in SILENT_TAGS) + ")"
_BLOCK = rf"(?i)</?(?:{BLOCK_TAGS})(?=[\s/>]){_REST}"
_INLINE = rf"<[a-zA-Z/!?]{_REST}"
_BLANKS = "[ \\t\\r\\f\\x0B ]+"
_BREAKS = r" ?\n[ \n]*"


def _digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def _record_id(*parts: Column) -> Column:
    """A name-based identifier (UUID version 8) of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[x for k, v in pairs for x in (F.lit(f"{k}: "), v, F.lit(CRLF))])


def _record(headers: Column, block: Column) -> Column:
    return F.concat(F.lit("WARC/1.1" + CRLF), headers, F.lit(CRLF), block, F.lit(GAP))


def response_records(pages: DataFrame, date: str = WARC_DATE) -> DataFrame:
    """(page_id, url, record): one WARC response record for each page."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("_p"), url.alias("_u"))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _fields(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length("_p").cast("string"))), F.lit(CRLF))
    rows = rows.withColumn("_b", F.concat(head, F.col("_p")))
    headers = _fields(
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", _record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("_u"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("_u")),
        ("WARC-Payload-Digest", _digest(F.col("_p"))),
        ("WARC-Block-Digest", _digest(F.col("_b"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("_b").cast("string")),
    )
    return rows.select("page_id", "url", _record(headers, F.col("_b")).alias("record"))


def _header(headers: Column, name: str) -> Column:
    return F.regexp_extract(headers, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def _decode_references(text: Column) -> Column:
    """Character references, named and by number, in one pass; unknown ones and numbers outside of Unicode stay as they are."""
    named = F.create_map(*[F.lit(x) for k, v in (NAMED | {"amp": "&"}).items() for x in (k, v)])
    every = F.from_json(F.lit(json.dumps(EVERY_NAME)), "map<string,string>")  # a constant; looked up where the common names fail
    windows = F.create_map(*[F.lit(x) for k, v in WINDOWS.items() for x in (k, v)])

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,40});", 1)
        char = lambda n: F.when(n == "", None).when(n.startswith("#"), number(n)).otherwise(F.coalesce(F.try_element_at(named, n), F.try_element_at(every, n)))
        return let(name, lambda n: F.coalesce(F.concat(char(n), F.substring(p, F.length(n) + 2, F.length(p))), F.concat(F.lit("&"), p)))

    def number(n: Column) -> Column:
        is_hex = F.substring(n, 2, 1).isin("x", "X")
        code = F.when(is_hex, F.conv(F.substring(n, F.lit(3), F.length(n)), 16, 10)).otherwise(F.substring(n, F.lit(2), F.length(n))).cast("int")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(code.between(0x80, 0x9F), F.try_element_at(windows, code)).when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    done = let(F.split(text, "&", -1), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), "")))
    return done


def plain_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags; one line per block; references decoded."""
    text = F.regexp_replace(html, _SILENT, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[\r\n]", " "), _BLOCK, "\n")
    text = _decode_references(F.regexp_replace(text, _INLINE, ""))
    text = F.regexp_replace(text, _BLANKS, " ")
    return F.btrim(F.regexp_replace(text, _BREAKS, "\n"), F.lit(" \n"))


def _unchunked(body: Column) -> Column:
    """The bytes of a body sent in chunks: between line ends stand sizes and data, and a size says how much of what follows is data."""
    lines = F.split(F.decode(body, "ISO-8859-1"), CRLF, -1)
    start = F.struct(F.lit(0).cast("long").alias("due"), F.array().cast("array<string>").alias("data"), F.lit(False).alias("over"))

    def step(state: Column, line: Column) -> Column:
        length = F.conv(F.regexp_extract(line, "^([0-9a-fA-F]{1,8})", 1), 16, 10).cast("long")
        size = F.coalesce(length, F.lit(0))
        header = F.struct(size.alias("due"), state["data"].alias("data"), (size == 0).alias("over"))
        got = F.substr(line, F.lit(1), F.least(state["due"], F.length(line).cast("long")).cast("int"))
        more = state["due"] > F.length(line)
        data = F.struct(F.greatest(state["due"] - F.length(line) - 2, F.lit(0)).alias("due"), F.concat(state["data"], F.array(F.when(more, F.concat(got, F.lit(CRLF))).otherwise(got))).alias("data"), F.lit(False).alias("over"))
        return F.when(state["over"], state).when(state["due"] > 0, data).otherwise(header)

    return F.encode(F.array_join(F.aggregate(lines, start, step)["data"], ""), "ISO-8859-1")


RESULT = ("record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_block_digest", "source_payload_digest", "digest_ok", "headers", "block")
#: Charsets of an HTTP head that are read byte by byte.
ONE_BYTE = r"(?i)charset=[\"']?(iso-8859-1|latin-?1|windows-1252|cp1252)"


def _utf8(value: Column) -> Column:
    return F.make_valid_utf8(value.cast("string"))


def derive(responses: DataFrame, record_col: str = "record") -> DataFrame:
    """Two derived records for each response record (a string, or bytes).

    Returns the other columns of ``responses`` with record_type, record_id, refers_to, target_uri, warc_date, content_type,
    content_length (bytes), block_digest, source_block_digest, source_payload_digest, digest_ok, headers and block;
    ``WARC/1.1``, headers, an empty line, block and two line ends make the record.
    """
    keep = [f"`{c}`" for c in responses.columns if c != record_col and c not in (*RESULT, "_rec", "_raw")]
    binary = dict(responses.dtypes)[record_col] == "binary"
    raw = F.coalesce(F.col(record_col).cast("binary"), F.lit(b""))
    head = lambda value, text: F.concat(F.substring_index(F.decode(value, "ISO-8859-1") if binary else text, GAP, 1), F.lit(CRLF))
    size = F.length if binary else F.octet_length  # of a head, in bytes
    r = responses.select(*keep, raw.alias("_raw"))
    r = r.withColumn("_h", head(F.col("_raw"), F.col("_raw").cast("string")))
    r = r.withColumn("_n", F.coalesce(_header(F.col("_h"), "Content-Length").try_cast("int"), F.lit(0)))
    r = r.withColumn("_b", F.substring("_raw", size(F.col("_h")) + F.lit(len(CRLF) + 1), F.col("_n")))
    r = r.withColumn("_crlf", head(F.col("_b"), F.col("_b").cast("string"))).withColumn("_lf", F.substring_index("_crlf", "\n\n", 1))
    bare = F.length("_lf") < F.length("_crlf")  # lines that end in a bare line feed
    r = r.withColumn("_body", F.substring("_b", F.when(bare, size(F.col("_lf")) + F.lit(3)).otherwise(size(F.col("_crlf")) + F.lit(len(CRLF) + 1)), F.octet_length("_b")))
    r = r.withColumn("_http", F.when(bare, F.concat("_lf", F.lit("\n"))).otherwise(F.col("_crlf"))).drop("_crlf", "_lf")
    packed = F.lower(F.trim(_header(F.col("_http"), "Content-Encoding")))
    r = r.withColumn("_packed", F.when(~packed.isin("", "identity"), packed))
    r = r.withColumn("_bytes", F.when(F.col("_packed").isNotNull(), F.lit(b"")).when(F.lower(_header(F.col("_http"), "Transfer-Encoding")).contains("chunked"), _unchunked(F.col("_body"))).otherwise(F.col("_body")))
    r = r.withColumn("_p", F.when(_header(F.col("_http"), "Content-Type").rlike(ONE_BYTE), F.decode("_bytes", "ISO-8859-1")).otherwise(_utf8(F.col("_bytes"))) if binary else _utf8(F.col("_bytes")))
    if binary:
        r = r.withColumns({c: _utf8(F.encode(c, "ISO-8859-1")) for c in ("_h", "_http")})
    h = {k: _header(F.col("_h"), k) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest")}
    title = F.btrim(F.regexp_replace(F.regexp_extract("_p", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " "))
    meta = _fields(
        ("sourceStatus", F.regexp_extract("_http", r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        ("sourceContentType", _header(F.col("_http"), "Content-Type")),
        ("sourceContentLength", _header(F.col("_http"), "Content-Length")),
        ("title", title),
        ("language", F.regexp_extract("_p", r"(?is)<html[^>]*\blang=[\"']?([a-zA-Z-]*)", 1)),
        ("outlinks", F.regexp_count("_p", F.lit(r"(?i)<a\s[^>]*href")).cast("string")),
    )
    lines = F.filter(F.split("_http", r"\r?\n"), lambda x, i: (i > 0) & x.contains(":"))
    meta = F.concat(meta, F.coalesce(F.concat(F.lit("sourceEncoding: "), F.col("_packed"), F.lit(" (not read)" + CRLF)), F.lit("")), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("sourceHeader: "), x, F.lit(CRLF))), ""))
    r = r.withColumns({"_id": h["WARC-Record-ID"], "_date": h["WARC-Date"], "_uri": h["WARC-Target-URI"], "_pd": h["WARC-Payload-Digest"], "_bd": h["WARC-Block-Digest"]})
    r = r.withColumn("_ok", F.col("_pd").isin(_digest(F.col("_bytes")), _digest(F.col("_body"))))  # of the payload, or as it was sent
    two = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("_p")).alias("block")),
    )
    r = r.select(*keep, "_id", "_date", "_uri", "_pd", "_bd", "_ok", F.inline(two))
    r = r.withColumn("record_id", _record_id(F.col("record_type"), F.col("_id"))).withColumn("block_digest", _digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    headers = _fields(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.col("_date")),
        ("WARC-Target-URI", F.col("_uri")),
        ("WARC-Refers-To", F.col("_id")),
        ("WARC-Refers-To-Target-URI", F.col("_uri")),
        ("WARC-Refers-To-Date", F.col("_date")),
        ("Source-Block-Digest", F.col("_bd")),
        ("Source-Payload-Digest", F.col("_pd")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.col("content_length").cast("string")),
    )
    return r.select(
        *keep, "record_type", "record_id", F.col("_id").alias("refers_to"), F.col("_uri").alias("target_uri"), F.col("_date").alias("warc_date"), "content_type", "content_length",
        "block_digest", F.col("_bd").alias("source_block_digest"), F.col("_pd").alias("source_payload_digest"), F.col("_ok").alias("digest_ok"), headers.alias("headers"), "block",
    )


def _sql_id(expr: str) -> str:
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-8' || h[18:20] || '-' || h[21:32] || '>' FROM (SELECT sha256({expr}) AS h))"


def _sql_text(html: str) -> str:
    """The text by patterns of its own: attributes one by one."""
    q = lambda s: s.replace("'", "''")
    value = "(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
    attributes = rf"(?:\s*[^\s=>]+(?:\s*=\s*{value})?)*\s*"
    silent = "|".join(rf"<{t}{attributes}>.*?(?:</{t}\s*>|\z)" for t in SILENT_TAGS)
    text = f"regexp_replace({html}, '(?is)<!--.*?(?:-->|\\z)|{q(silent)}', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[\r\n]', ' ', 'g'), '(?i)</?(?:{BLOCK_TAGS})(?:\s{q(attributes)}|/)?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '</?[a-zA-Z][a-zA-Z0-9:-]*{q(attributes)}>|<[!?][^>]*>', '', 'g')"
    text = f"num({text})"
    for name, char in NAMED.items():
        text = f"replace({text}, '&{name};', '{q(char)}')"
    text = f"regexp_replace(replace({text}, '&amp;', '&'), '{_BLANKS}', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '{_BREAKS}', chr(10), 'g'), ' ' || chr(10))"


def _oracle() -> str:
    """The records that follow from the pages; character references by number are left out where pages have none."""
    text = _sql_text("html").replace("num(", "(")
    fields = lambda *pairs: " || ".join(f"'{k}: ' || {v} || chr(13) || chr(10)" for k, v in pairs)
    meta = fields(
        ("sourceStatus", "'200'"), ("sourceContentType", "'text/html; charset=utf-8'"), ("sourceContentLength", "strlen(html)::VARCHAR"),
        ("title", r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g'))"),
        ("language", r"""regexp_extract(html, '(?is)<html[^>]*\blang=["'']?([a-zA-Z-]*)', 1)"""),
        ("outlinks", r"len(regexp_extract_all(html, '(?i)<a\s[^>]*href'))::VARCHAR"),
        ("sourceHeader", "'Content-Type: text/html; charset=utf-8'"), ("sourceHeader", "'Content-Length: ' || strlen(html)"),
    )
    headers = fields(
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "u"), ("WARC-Refers-To", "id"), ("WARC-Refers-To-Target-URI", "u"), ("WARC-Refers-To-Date", "warc_date"),
        ("Source-Block-Digest", "bd"), ("Source-Payload-Digest", "pd"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length::VARCHAR"),
    )
    return rf"""
WITH p AS (SELECT page_id, url, coalesce(url, '') AS u, coalesce(html, '') AS html, '{WARC_DATE}' AS warc_date FROM pages),
s AS (SELECT *, {_sql_id("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || u")} AS id, 'sha256:' || sha256(html) AS pd,
             'sha256:' || sha256('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html) AS bd FROM p),
k AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {meta} AS block FROM s
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM s),
i AS (SELECT *, {_sql_id("record_type || chr(10) || id")} AS record_id, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM k)
SELECT page_id, url, record_type, record_id, id AS refers_to, u AS target_uri, warc_date, content_type, content_length, block_digest,
       bd AS source_block_digest, pd AS source_payload_digest, true AS digest_ok, {headers} AS headers, block FROM i
"""


ORACLE_SQL = _oracle()
