"""Naming, admission, triage and formatting bound to pages, documents, events, orders and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from sheetwise.functions import formats, names
from sheetwise.operators import admission

SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(e: str) -> str:
    return f"regexp_replace({e}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_forbidden(e: str) -> str:
    return rf"""regexp_replace({e}, '[<>:"/\\|?*\x00-\x1F]', '_', 'g')"""


def sql_server_name(e: str, instant: str = "0") -> str:
    dots = rf"regexp_replace({sql_forbidden(e)}, '\.\.+', '_', 'g')"
    cut = f"substring({sql_trim(f'''regexp_replace({dots}, '[. ]+$', '')''')}, 1, 180)"
    return f"(CASE WHEN coalesce({cut}, '') IN ('', '.', '..') THEN 'upload-' || ({instant}) ELSE {cut} END)"


def sql_ext(e: str) -> str:
    return rf"regexp_extract({e}, '\.[^.]+$')"


def sql_desktop_name(e: str) -> str:
    cut = f"regexp_replace(substring({sql_forbidden(sql_trim(e))}, 1, 180), '[. ]+$', '')"
    guard = f"(CASE WHEN starts_with({cut}, '.incoming-') THEN '_' || {cut} ELSE {cut} END)"
    stem = rf"lower(regexp_replace({guard}, '\.[^.]*$', ''))"
    return (
        f"(CASE WHEN {stem} IN ('con','prn','aux','nul','com1','com2','com3','com4','com5','com6','com7','com8','com9',"
        f"'lpt1','lpt2','lpt3','lpt4','lpt5','lpt6','lpt7','lpt8','lpt9') THEN '_' || {guard} ELSE {guard} END)"
    )


@query("nam01_sanitize_name_server", f"SELECT doc_id, {sql_server_name('text', 'doc_id')} AS name FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", names.sanitize_server(F.col("text"), F.col("doc_id")).alias("name"))


TYPED = "(CASE page_id % 4 WHEN 0 THEN ' con.' || url WHEN 1 THEN 'lpt1.txt' WHEN 2 THEN '.incoming-' || url ELSE url || '. ' END)"


def typed_pages(spark, d):
    """Pages with a name somebody might type: reserved stems, reserved prefixes, trailing dots."""
    url = F.col("url")
    turn = F.col("page_id") % 4
    typed = (
        F.when(turn == 0, F.concat(F.lit(" con."), url))
        .when(turn == 1, "lpt1.txt")
        .when(turn == 2, F.concat(F.lit(".incoming-"), url))
        .otherwise(F.concat(url, F.lit(". ")))
    )
    return table(spark, d, "pages").select("page_id", "url", typed.alias("typed"))


@query("nam02_sanitize_name_desktop", f"SELECT page_id, {sql_desktop_name('typed')} AS name FROM (SELECT page_id, {TYPED} AS typed FROM pages)")
def _(spark, d):
    return typed_pages(spark, d).select("page_id", names.sanitize_desktop(F.col("typed")).alias("name"))


@query(
    "nam04_name_is_landable",
    f"""SELECT doc_id, kind, n = {sql_server_name('n')} AS landable FROM (
        SELECT doc_id, 'raw' AS kind, text AS n FROM documents
        UNION ALL SELECT doc_id, 'cleaned', {sql_server_name('text', 'doc_id')} FROM documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    cleaned = names.sanitize_server(F.col("text"), F.col("doc_id"))
    return (
        docs.select("doc_id", F.explode(F.create_map(
            F.lit("raw"), F.col("text"), F.lit("cleaned"), cleaned)).alias("kind", "n"))
        .select("doc_id", "kind", names.is_landable(F.col("n")).alias("landable"))
    )


@query("nam05_scan_name", "SELECT event_id, 'Scan ' || strftime(ts, '%Y-%m-%d at %H.%M.%S') || '.jpg' AS name FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", names.scan_name(F.col("ts")).alias("name"))


@query(
    "nam07_decode_name",
    "SELECT page_id, coalesce(url_decode(replace(replace(url, '/', '%2F'), ':', '%3A') || '+a%20b%zz%C3%A9'), '') AS name FROM pages",
)
def _(spark, d):
    encoded = F.replace(F.replace(F.col("url"), F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3A"))
    encoded = F.concat(encoded, F.lit("+a%20b%zz%C3%A9"))
    return table(spark, d, "pages").select("page_id", names.decode_name(encoded).alias("name"))


@query(
    "nam08_stem_and_extension",
    rf"""SELECT page_id, {sql_ext('url')} AS ext, substring(url, 1, length(url) - length({sql_ext('url')})) AS stem,
        CASE WHEN {sql_ext('url')} = '' THEN 'FILE' ELSE upper(substring(ltrim({sql_ext('url')}, '.'), 1, 4)) END AS badge FROM pages""",
)
def _(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", names.extension(url).alias("ext"), names.stem(url).alias("stem"), names.extension_badge(url).alias("badge")
    )


@query(
    "adm01_admit_uploads",
    f"""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE replace(text, '%', '%25') END AS enc,
            CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars * 2000000 END AS declared, n_chars * 3000000 AS received FROM documents),
        v AS (SELECT *, coalesce(url_decode(enc), '') AS dec FROM u), w AS (SELECT *, {sql_server_name('dec')} AS name FROM v),
        x AS (SELECT doc_id, name, CASE WHEN dec = '' THEN 1 WHEN declared < 0 THEN 2 WHEN declared > 5368709120 THEN 3
            WHEN name <> {sql_server_name('name')} THEN 4 WHEN received > 5368709120 THEN 3 ELSE 0 END AS v FROM w)
        SELECT doc_id, name, CASE v WHEN 0 THEN 201 WHEN 3 THEN 413 ELSE 400 END AS status,
            CASE v WHEN 1 THEN 'Missing file name' WHEN 2 THEN 'Invalid file size' WHEN 3 THEN 'File exceeds 5.0 GB limit'
                WHEN 4 THEN 'Invalid file name' END AS reason FROM x""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    uploads = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 11 != 0, F.replace("text", F.lit("%"), F.lit("%25"))).alias("name_encoded"),
        F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("n_chars") * 2000000).alias("declared_bytes"),
        (F.col("n_chars") * 3000000).alias("received_bytes"),
    )
    return admission.admit_uploads(uploads).select("doc_id", "name", "status", "reason")


def header_photos(spark, d):
    """Documents turned into photo heads: PNG, JPEG (with a skipped segment), HEIC, or the bare text."""
    docs = table(spark, d, "documents")
    w, h = F.col("n_chars") + 1, F.length("text") * 40 + 7

    def number(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 8), number(h, 8), F.lit("0802000000"))
    small_w, small_h = F.least(w, F.lit(65535)), F.least(h, F.lit(65535))
    jpeg = F.concat(F.lit("FFD8FFFFE00006AABBCCDDFFC0001108"), number(small_h, 4), number(small_w, 4), F.lit("030122"))
    heic = F.lit("00000018667479706D69663100000000")
    turn = F.col("doc_id") % 4
    content = (
        F.when(turn == 0, F.unhex(png)).when(turn == 1, F.unhex(jpeg)).when(turn == 2, F.unhex(heic))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return docs.select("doc_id", "lang", content.alias("content"))


SQL_HEADS = """heads AS (SELECT doc_id, lang, doc_id % 4 AS turn, n_chars + 1 AS w, length(text) * 40 + 7 AS h,
    octet_length(encode(text)) AS bytes FROM documents),
    sized AS (SELECT *, CASE turn WHEN 0 THEN w WHEN 1 THEN least(w, 65535) END AS width,
        CASE turn WHEN 0 THEN h WHEN 1 THEN least(h, 65535) END AS height FROM heads)"""


@query(
    "adm02_triage_photos",
    f"""WITH {SQL_HEADS}, v AS (SELECT doc_id, CASE WHEN turn = 3 AND bytes < 16 THEN 1 WHEN turn = 2 THEN 2
            WHEN width * height > 120000000 OR width > 30000 OR height > 30000 THEN 3 ELSE 0 END AS v FROM sized)
        SELECT doc_id, CASE v WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 415 ELSE 413 END AS status,
            CASE v WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' WHEN 2 THEN 'heic' ELSE 'too large' END AS reason FROM v""",
)
def _(spark, d):
    return admission.triage_photos(header_photos(spark, d)).select("doc_id", "status", "reason")


@query(
    "adm03_photo_catalog",
    f"""WITH {SQL_HEADS} SELECT lang, count(*) AS n, count(width) AS sized, sum(width)::BIGINT AS width_sum,
        sum(height)::BIGINT AS height_sum, round(max(width * height / 1e6), 6) AS largest_mp FROM sized GROUP BY lang""",
)
def _(spark, d):
    catalog = admission.photo_catalog(header_photos(spark, d))
    return catalog.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("width").alias("sized"), F.sum("width").alias("width_sum"),
        F.sum("height").alias("height_sum"), F.round(F.max("megapixels"), 6).alias("largest_mp"),
    )


@query(
    "adm04_validate_scan_update",
    r"""WITH u AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'no id' ELSE md5(user_id::VARCHAR) END AS id,
            CASE event_type WHEN 'view' THEN ' Grey ' WHEN 'click' THEN 'BW' WHEN 'signup' THEN '' WHEN 'error' THEN NULL ELSE event_type END AS f,
            CASE WHEN (props->>'k')::INT % 5 = 4 THEN NULL ELSE (props->>'k')::INT % 5 * 90 END AS r FROM events),
        v AS (SELECT event_id, id, CASE lower(trim(f)) WHEN 'grey' THEN 'gray' WHEN 'bw' THEN 'bw' WHEN 'purchase' THEN NULL ELSE 'original' END AS nf,
            coalesce(r, 45 * (event_id % 2)) AS nr FROM u),
        w AS (SELECT *, CASE WHEN NOT regexp_matches(id, '^[a-f0-9]{32}$') THEN 'Not found' WHEN nf IS NULL THEN 'Unknown filter'
            WHEN nr NOT IN (0, 90, 180, 270) THEN 'Rotation must be 0, 90, 180 or 270' END AS error FROM v)
        SELECT event_id, error, CASE WHEN error IS NULL THEN nf END AS new_filter, CASE WHEN error IS NULL THEN nr::INT END AS new_rotate FROM w""",
)
def _(spark, d):
    events = table(spark, d, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    updates = events.select(
        "event_id",
        F.when(F.col("event_id") % 13 == 0, "no id").otherwise(F.md5(F.col("user_id").cast("string"))).alias("id"),
        F.when(kind == "view", " Grey ").when(kind == "click", "BW").when(kind == "signup", "")
        .when(kind == "error", F.lit(None)).otherwise(kind).alias("filter"),
        F.when(k % 5 != 4, k % 5 * 90).alias("rotate"),
        F.lit("original").alias("now_filter"),
        (F.col("event_id") % 2 * 45).cast("int").alias("now_rotate"),
    )
    checked = admission.validate_scan_update(updates, "id", "filter", "rotate", "now_filter", "now_rotate")
    return checked.select("event_id", "error", "new_filter", "new_rotate")


@query(
    "adm05_parse_updates",
    """WITH b AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'not json' WHEN 'view' THEN '{"rotate": ' || (props->>'k') || ', "filter": "bw"}'
            WHEN 'click' THEN '{"filter": null}' WHEN 'signup' THEN '{"rotate": "x"}' ELSE '{"pad": "' || repeat('x', 65536) || '"}' END AS body, event_type, props FROM events)
        SELECT event_id, CASE event_type WHEN 'error' THEN 400 WHEN 'signup' THEN 400 WHEN 'purchase' THEN 413 ELSE 200 END AS status,
            CASE WHEN event_type = 'view' THEN (body->>'rotate')::INT END AS rotate, CASE WHEN event_type = 'view' THEN body->>'filter' END AS filter FROM b""",
)
def _(spark, d):
    events = table(spark, d, "events")
    kind = F.col("event_type")
    body = (
        F.when(kind == "error", "not json")
        .when(kind == "view", F.concat(F.lit('{"rotate": '), F.get_json_object("props", "$.k"), F.lit(', "filter": "bw"}')))
        .when(kind == "click", '{"filter": null}')
        .when(kind == "signup", '{"rotate": "x"}')
        .otherwise(F.concat(F.lit('{"pad": "'), F.repeat(F.lit("x"), 65536), F.lit('"}')))
    )
    parsed = admission.parse_updates(events.select("event_id", body.alias("body")), "body")
    return parsed.select("event_id", "status", F.col("update.rotate").alias("rotate"), F.col("update.filter").alias("filter"))


@query(
    "adm06_flag_risky",
    rf"""SELECT page_id, lower({sql_ext("n")}) IN ('.exe', '.js', '.jar', '.ps1', '.msi') AS risky FROM
        (SELECT page_id, 'page' || page_id || CASE page_id % 5 WHEN 0 THEN '.EXE' WHEN 1 THEN '.js' WHEN 2 THEN '.html' WHEN 3 THEN '' ELSE '.tar.Ps1' END AS n FROM pages)""",
)
def _(spark, d):
    turn = F.col("page_id") % 5
    ending = F.when(turn == 0, ".EXE").when(turn == 1, ".js").when(turn == 2, ".html").when(turn == 3, "").otherwise(".tar.Ps1")
    named = F.concat(F.lit("page"), F.col("page_id").cast("string"), ending)
    return table(spark, d, "pages").select("page_id", names.is_risky(named).alias("risky"))


def _sql_tenths(e: str) -> str:
    return f"(floor({e} * 10 + 0.5)::BIGINT // 10) || '.' || (floor({e} * 10 + 0.5)::BIGINT % 10)"


@query(
    "fmt01_format_bytes",
    f"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey WHEN 2 THEN o_totalprice::BIGINT
            WHEN 3 THEN (o_totalprice * 1000)::BIGINT ELSE (o_totalprice * 30000000)::BIGINT END AS b FROM orders)
        SELECT o_orderkey,
          CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {_sql_tenths('(b / 1024)')} || ' KB'
            WHEN b < 1073741824 THEN {_sql_tenths('(b / 1048576)')} || ' MB' WHEN b < 1099511627776 THEN {_sql_tenths('(b / 1073741824)')} || ' GB'
            ELSE {_sql_tenths('(b / 1099511627776)')} || ' TB' END AS server,
          CASE WHEN b >= 1073741824 THEN format('{{:,}}', floor(b / 1073741824 * 10 + 0.5)::BIGINT // 10) || '.' || (floor(b / 1073741824 * 10 + 0.5)::BIGINT % 10) || ' GB'
            WHEN b >= 1048576 THEN format('{{:,}}', floor(b / 1048576 * 10 + 0.5)::BIGINT // 10) || '.' || (floor(b / 1048576 * 10 + 0.5)::BIGINT % 10) || ' MB'
            WHEN b >= 1024 THEN format('{{:,}}', floor(b / 1024 + 0.5)::BIGINT) || ' KB' ELSE b || ' B' END AS desktop,
          CASE WHEN b >= 1073741824 THEN {_sql_tenths('(b / 1073741824)')} || ' GB' WHEN b >= 1048576 THEN {_sql_tenths('(b / 1048576)')} || ' MB'
            WHEN b >= 1024 THEN floor(b / 1024 + 0.5)::BIGINT || ' KB' ELSE b || ' B' END AS phone FROM s""",
)
def _(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    size = (
        F.when(key % 5 == 0, F.lit(0)).when(key % 5 == 1, key).when(key % 5 == 2, F.rint(price).cast("long"))
        .when(key % 5 == 3, F.rint(price * 1000).cast("long")).otherwise(F.rint(price * 30000000).cast("long"))
    )
    sized = table(spark, d, "orders").select("o_orderkey", size.alias("b"))
    return sized.select(
        "o_orderkey", *[formats.format_bytes(F.col("b"), style).alias(style) for style in ("server", "desktop", "phone")]
    )


@query(
    "fmt02_transfer_speed",
    f"""WITH r AS (SELECT event_id, (event_id * 1000) / greatest(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END, 0.001::DOUBLE) AS rate FROM events)
        SELECT event_id, CASE WHEN rate >= 1048576 THEN {_sql_tenths('(rate / 1048576)')} || ' MB/s'
            ELSE greatest(1, floor(rate / 1024 + 0.5)::BIGINT) || ' KB/s' END AS speed FROM r""",
)
def _(spark, d):
    seconds = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))
    return table(spark, d, "events").select(
        "event_id", formats.transfer_speed(F.col("event_id") * 1000, seconds).alias("speed")
    )


@query("hsh01_content_fingerprint", "SELECT doc_id, substring(sha256(text), 1, 16) AS tag FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", formats.content_fingerprint(F.col("text")).alias("tag"))
