"""Text, matching, scoring and search queries over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import text as X
from sheaf.operators import matching as M
from sheaf.operators import scoring as C
from sheaf.operators import search as Q
from sheaf.operators.prefix import ranked
from sheaf.queries.registry import query
from sheaf.sources.text import text_blocks as read_text


@query("""
    WITH b AS (SELECT doc_id, ord, trim(block, e' \\n\\t\\r') AS block FROM documents, unnest(string_split(nfc_normalize(replace(replace(text, e'\\r\\n', e'\\n'), e'\\r', e'\\n')), e'\\n\\n')) WITH ORDINALITY AS u(block, ord))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS ord, regexp_replace(block, '[ \\t]+\\n', e'\\n', 'g') AS text, len(string_split(block, e'\\n'))::INT AS lines
    FROM b WHERE block <> ''""")
def text_blocks(t):
    return read_text(t.documents)


@query("""
    SELECT lang, count(*) AS docs, sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')))::BIGINT AS words,
           sum(len(list_filter(string_split(text, e'\\n'), lambda l: trim(l) <> '')))::BIGINT AS lines
    FROM documents GROUP BY lang""")
def doc_counts(t):
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    lines = F.size(F.filter(F.split("text", "\n"), lambda w: F.trim(w) != ""))
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(words).alias("words"), F.sum(lines).alias("lines"))


_EMAIL = M.EMAIL.replace("'", "''")
# the search form in SQL
_AS = ("０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹\u00a0\u2010\u2011\u2012\u2013\u2014\u2212", "0123456789" * 3 + " ------")
_FORM = f"nfc_normalize(translate(text, '{_AS[0]}\u00ad\u200b\u200c\u200d\u2060\ufeff', '{_AS[1]}'))"


def _runs(chain: str, part: str, least: int, most: int, start: str = "") -> str:
    """Runs of whole groups as codes: (doc_id, code)."""
    same = "{0}.doc_id = a.doc_id AND {0}.cid = a.cid"
    return f"""
    c AS (SELECT doc_id, ch, cid FROM (SELECT doc_id, {_FORM} AS t FROM documents), unnest(regexp_extract_all(t, '{chain}')) WITH ORDINALITY AS u(ch, cid) WHERE length(ch) >= {least}),
    g AS (SELECT doc_id, cid, p, k FROM c, unnest(regexp_extract_all(ch, '{part}')) WITH ORDINALITY AS u(p, k)),
    b AS (SELECT * FROM g WHERE regexp_matches(p, '^{start}')),
    e AS (SELECT a.doc_id, a.cid, a.k AS i, z.k AS j FROM b a JOIN g z ON {same.format('z')} AND z.k BETWEEN a.k AND a.k + {most}),
    r AS (SELECT a.doc_id, a.cid, i, j, string_agg(x.p, '' ORDER BY x.k) AS code FROM e a JOIN g x ON {same.format('x')} AND x.k BETWEEN i AND j GROUP BY ALL)"""


@query(f"SELECT doc_id, len(h)::INT AS n, h[1] AS first FROM (SELECT doc_id, regexp_extract_all({_FORM}, '{_EMAIL}') AS h FROM documents) WHERE len(h) > 0")
def pii_email(t):
    found = t.documents.select("doc_id", M.hits(F.col("text"), "email").alias("h")).filter("size(h) > 0")
    return found.select("doc_id", F.size("h").alias("n"), F.get("h", 0).alias("first"))


def _counted(t, preset: str):
    found = t.documents.select("doc_id", F.size(M.matches(F.col("text"), preset)).cast("long").alias("n"))
    return found.filter("n > 0")


@query(f"""
    WITH c AS (SELECT doc_id, unnest(regexp_extract_all({_FORM}, '\\+?[0-9]+')) AS run FROM documents)
    SELECT doc_id, count(*) AS n FROM c WHERE regexp_full_match(run, '\\+[1-9][0-9]{{1,14}}') OR regexp_full_match(run, '\\+?0[0-9]{{9,10}}') GROUP BY 1""")
def pii_phone(t):
    return _counted(t, "phone")


@query(f"""
    WITH {_runs('[0-9]+(?:[ -][0-9]+)*', '[0-9]+', 13, 18)},
    l AS (SELECT doc_id, code, list_sum(list_transform(range(0, length(code)), lambda i: CASE WHEN i % 2 = 0 THEN code[length(code) - i]::INT WHEN code[length(code) - i]::INT > 4 THEN code[length(code) - i]::INT * 2 - 9 ELSE code[length(code) - i]::INT * 2 END)) AS s
          FROM r WHERE length(code) BETWEEN 13 AND 19)
    SELECT doc_id, count(*) AS n FROM l WHERE s % 10 = 0 GROUP BY 1""")
def pii_card(t):
    return _counted(t, "card")


@query(f"""
    WITH {_runs('[0-9]+(?:[ .-][0-9]+)*', '[0-9]+', 9, 11)}
    SELECT doc_id, count(*) FILTER (length(code) = 12) AS cccd, count(*) AS cmnd FROM r WHERE length(code) IN (9, 12) GROUP BY 1""")
def pii_national(t):
    def count(preset: str):
        return F.size(F.filter("m", lambda x: x.preset == preset)).cast("long").alias(preset)

    found = t.documents.select("doc_id", M.matches(F.col("text"), "cccd", "cmnd").alias("m"))
    return found.select("doc_id", count("cccd"), count("cmnd")).filter("cmnd > 0")


_MOD_97 = """list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(upper(code), 5) || substr(upper(code), 1, 4), ''),
    lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::HUGEINT ELSE (ascii(c) - 55)::HUGEINT END)), lambda acc, x: (acc * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"""


@query(f"""
    WITH {_runs('[A-Za-z0-9]+(?: [A-Za-z0-9]+)*', '[A-Za-z0-9]+', 15, 31, '[A-Za-z]{2}[0-9]{2}')},
    v AS (SELECT doc_id, {_MOD_97} = 1 AS valid FROM r WHERE length(code) BETWEEN 15 AND 34)
    SELECT d.doc_id, count(*) FILTER (valid) AS n FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id GROUP BY 1""")
def pii_iban(t):
    return t.documents.select("doc_id", F.size(M.matches(F.col("text"), "iban")).cast("long").alias("n"))


@query(f"""
    WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'GB82WEST12345698765432' ELSE 'DE' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') || '37040044053201300' || (s_suppkey % 10) END AS code FROM supplier)
    SELECT s_suppkey, {_MOD_97} = 1 AS valid FROM v""")
def iban_codes(t):
    key = F.col("s_suppkey")
    other = F.concat(F.lit("DE"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("37040044053201300"), (key % 10).cast("string"))
    return t.supplier.select("s_suppkey", M.iban_valid(F.when(key % 2 == 0, "GB82WEST12345698765432").otherwise(other)).alias("valid"))


# texts around the hits, and the hits as marks, in turn
_CLEAN = f"""d AS (SELECT doc_id, string_split_regex(text, '{_EMAIL}') AS parts, regexp_extract_all(text, '{_EMAIL}') AS h FROM documents),
    c AS (SELECT doc_id, h, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(repeat('█', length(h[i])), '')), '') AS clean FROM d)"""


@query(f"WITH {_CLEAN} SELECT doc_id, sha256(clean) AS digest, len(h)::INT AS hits FROM c")
def redact_text(t):
    text = F.col("text")
    out = t.documents.select("doc_id", M.redact(text, ["email"]).alias("clean"), F.size(M.hits(text, "email")).alias("hits"))
    return out.select("doc_id", F.sha2(F.col("clean").cast("binary"), 256).alias("digest"), "hits")


@query(f"""
    WITH {_CLEAN}
    SELECT count(*) AS docs, sum(len(h))::BIGINT AS found, sum(len(regexp_extract_all(clean, '{_EMAIL}')))::BIGINT AS left_over,
           sum(length(clean) - length(replace(clean, '█', '')))::BIGINT AS marks FROM c""")
def redact_verify(t):
    """Search the covered texts again."""
    text, clean = F.col("text"), F.col("clean")
    out = t.documents.select(F.size(M.hits(text, "email")).alias("found"), M.redact(text, ["email"]).alias("clean"))
    marks = F.length(clean) - F.length(F.replace(clean, F.lit("█"), F.lit("")))
    return out.agg(
        F.count("*").alias("docs"), F.sum("found").cast("long").alias("found"),
        F.sum(F.size(M.matches(clean, "email"))).cast("long").alias("left_over"), F.sum(marks).cast("long").alias("marks"),
    )


@query("""
    SELECT c_custkey, CASE WHEN regexp_matches(f, '^[=+\\-@\\t\\r]') THEN '''' || f ELSE f END AS field,
           CASE WHEN regexp_matches(n, '[,"\\r\\n]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END AS name
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '-' || c_name ELSE c_name END AS f, CASE WHEN c_custkey % 2 = 0 THEN c_name || ', "x"' ELSE c_name END AS n FROM customer)""")
def csv_guard_escape(t):
    f = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name"))
    n = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(', "x"'))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", X.guard_formula(f).alias("field"), X.escape_csv(n).alias("name"))


@query("""
    SELECT n_regionkey, string_agg(n_nationkey || ',' || n_name, e'\\r\\n' ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1""")
def table_to_csv(t):
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), X.escape_csv(F.col("n_name")))
    return t.nation.groupBy("n_regionkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r.line), "\r\n").alias("csv")
    )


@query(r"""
    WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '0' || p_size WHEN 1 THEN '+' || p_size WHEN 2 THEN p_size || '.5' WHEN 3 THEN '-' || p_size WHEN 4 THEN p_size || 'e3' ELSE p_name END AS cell FROM part)
    SELECT p_partkey, regexp_matches(cell, '^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,2})?$') AS numeric FROM v""")
def xlsx_numeric(t):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    forms = [F.concat(F.lit("0"), size), F.concat(F.lit("+"), size), F.concat(size, F.lit(".5")), F.concat(F.lit("-"), size), F.concat(size, F.lit("e3"))]
    cell = F.col("p_name")
    for i, form in enumerate(forms):
        cell = F.when(k == i, form).otherwise(cell)
    return t.part.select("p_partkey", X.is_numeric(cell).alias("numeric"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr((65 + p_partkey)::INT) WHEN p_partkey < 702 THEN chr((65 + (p_partkey - 26) // 26)::INT) || chr((65 + p_partkey % 26)::INT)
           ELSE chr((65 + (p_partkey - 702) // 676)::INT) || chr((65 + ((p_partkey - 702) % 676) // 26)::INT) || chr((65 + p_partkey % 26)::INT) END AS name FROM part""")
def column_names(t):
    return t.part.select("p_partkey", X.column_name(F.col("p_partkey")).alias("name"))


@query("""
    WITH l AS (SELECT doc_id, regexp_extract(regexp_replace(text, '"(?:[^"]|"")*"', '', 'g'), '(?m)^[^\\n]*[,;\\t][^\\n]*$') AS line FROM documents),
    c AS (SELECT doc_id, length(line) - length(replace(line, ',', '')) AS a, length(line) - length(replace(line, ';', '')) AS b, length(line) - length(replace(line, e'\\t', '')) AS d FROM l)
    SELECT doc_id, CASE WHEN b > a AND b >= d THEN ';' WHEN d > a AND d > b THEN e'\\t' ELSE ',' END AS delimiter FROM c""")
def csv_sniff(t):
    return t.documents.select("doc_id", X.sniff_delimiter(F.col("text")).alias("delimiter"))


@query(f"SELECT lang, CASE WHEN regexp_matches(lower(text), '[{X.VIETNAMESE}]') THEN 'vi' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY ALL")
def detect_lang_vi(t):
    return t.documents.groupBy("lang", X.is_vietnamese(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


_STOP = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)


def _tokens(text: str) -> str:
    """Folded words, stop words included."""
    return f"regexp_extract_all(strip_accents(replace(lower({text}), 'đ', 'd')), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""
    WITH w AS (SELECT lang, unnest({_tokens('text')}) AS token FROM documents)
    SELECT lang, token, count(*) AS n FROM w WHERE token NOT IN ({_STOP}) GROUP BY ALL""")
def token_freq(t):
    return Q.token_frequencies(t.documents, "lang", "text")


_SENTENCES = r"""
    s AS (SELECT doc_id, ord, trim(sentence, e' \t\n\r\f\x0B') AS sentence FROM documents, unnest(string_split(regexp_replace(text, '([.!?])\s+', e'\\1\n', 'g'), e'\n')) WITH ORDINALITY AS u(sentence, ord) WHERE trim(sentence, e' \t\n\r\f\x0B') <> ''),
    p AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS position, sentence FROM s)"""


@query(f"""
    WITH {_SENTENCES}, w AS (SELECT doc_id, position, token FROM p, unnest({_tokens('sentence')}) AS u(token) WHERE token NOT IN ({_STOP})),
    f AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) WHERE token NOT IN ({_STOP}) GROUP BY ALL),
    q AS (SELECT w.doc_id, w.position, sum(n) / greatest(1, sqrt(count(*))) AS score FROM w JOIN f ON w.doc_id = f.doc_id AND w.token = f.token GROUP BY ALL),
    r AS (SELECT p.doc_id, p.position, sentence, round(coalesce(score, 0), 6) AS score FROM p LEFT JOIN q ON p.doc_id = q.doc_id AND p.position = q.position)
    SELECT doc_id, position, sha256(left(sentence, 1000)) AS digest, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS k FROM r) WHERE k <= 3""")
def summarize_topk(t):
    out = Q.summary(t.documents, "doc_id", "text")
    return out.select("doc_id", "position", F.sha2(F.col("sentence").cast("binary"), 256).alias("digest"), "score")


@query(f"""
    WITH p AS (SELECT doc_id, (ord - 1)::INT AS position, trim(quote, e' \\t\\r\\f\\x0B') AS quote FROM documents, unnest(regexp_extract_all(text, '[^\\n.!?]{{1,1000}}[^\\n.!?]{{0,1000}}[.!?]?')) WITH ORDINALITY AS u(quote, ord)),
    q AS (SELECT doc_id, position, quote, (SELECT count(DISTINCT x) FROM unnest({_tokens('quote')}) u(x) WHERE x IN ('license', 'released', 'under', 'mit')) / 4.0 AS score FROM p)
    SELECT doc_id, position, sha256(quote) AS digest, round(score, 6) AS score FROM q WHERE score > 0 ORDER BY score DESC, doc_id, position LIMIT 20""")
def ask_passages(t):
    out = Q.answers(t.documents, "doc_id", "text", "Released under the MIT license?", 20)
    return out.select("doc_id", "position", F.sha2(F.col("quote").cast("binary"), 256).alias("digest"), F.round("score", 6).alias("score"))


@query(r"""
    WITH l AS (SELECT doc_id, ord, trim(line, e' \t\r\f\x0B') AS line FROM documents, unnest(string_split_regex(text, '\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')) WITH ORDINALITY AS u(line, ord)),
    k AS (SELECT doc_id, ord, CASE WHEN contains(line, '|') THEN list_transform(string_split(replace(trim(line, '|'), '\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '\|'), e' \t\r\f\x0B'))
                                   ELSE string_split_regex(line, '\t| {2,}') END AS cells FROM l),
    r AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM k WHERE len(cells) > 1 AND len(list_filter(cells, lambda c: c <> '')) > 0),
    s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS size FROM r WHERE len(list_filter(cells, lambda c: NOT regexp_full_match(c, ':?-{2,}:?'))) > 0)
    SELECT doc_id, "table"::INT AS "table", count(*) AS rows, sum(len(cells))::BIGINT AS cells, sha256(string_agg(array_to_string(cells, '|'), e'\n' ORDER BY ord)) AS digest
    FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS "table" FROM s WHERE size >= 2) GROUP BY ALL""")
def line_tables(t):
    out = Q.line_tables(t.documents, "doc_id", "text")
    lines = F.array_sort(F.collect_list(F.struct("row", F.array_join("cells", "|").alias("line"))))
    text = F.array_join(F.transform(lines, lambda r: r.line), "\n")
    return out.groupBy("doc_id", "table").agg(
        F.count("*").alias("rows"), F.sum(F.size("cells")).alias("cells"), F.sha2(text.cast("binary"), 256).alias("digest")
    )


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_dedup(t):
    return t.documents.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(regexp_extract(p_name, '^[^0-9]*')), CAST(coalesce(nullif(regexp_extract(p_name, '[0-9]+'), ''), '0') AS BIGINT), p_name, p_partkey) AS place FROM part""")
def natural_sort(t):
    rows = t.part.select("p_partkey", "p_name", X.natural_key(F.col("p_name")).alias("key"))
    return ranked(rows, ["key", "p_name", "p_partkey"], "place").drop("key")


@query(r"""
    WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '../' || c_name || '*?.' ELSE c_name || ' é' END AS name FROM customer)
    SELECT c_custkey, left(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._ -]+', '_', 'g'), '^[. ]+', ''), '[. ]+$', ''), 100) AS stem FROM v""")
def sanitize_stem(t):
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("../"), "c_name", F.lit("*?."))).otherwise(F.concat("c_name", F.lit(" é")))
    return t.customer.select("c_custkey", X.sanitize_stem(name).alias("stem"))


@query("""SELECT trim(regexp_replace(regexp_replace(lower(c_name), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS form, count(*) AS n FROM customer GROUP BY 1""")
def running_text(t):
    return t.customer.groupBy(X.running_text(F.col("c_name")).alias("form")).agg(F.count("*").alias("n"))


@query("""
    SELECT l_orderkey, l_linenumber, l_linenumber % 4 <> 3 AS is_number FROM lineitem""")
def page_number_lines(t):
    n = F.col("l_linenumber")
    forms = [F.concat(F.lit("Page "), n.cast("string"), F.lit(" of 9")), F.concat(F.lit("- "), n.cast("string"), F.lit(" -")), F.lit("xiv"), F.lit("Section 3 text")]
    line = F.lit("")
    for i, form in enumerate(forms):
        line = F.when(n % 4 == i, form).otherwise(line)
    return t.lineitem.select("l_orderkey", "l_linenumber", X.is_page_number(line).alias("is_number"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""")
def escape_html(t):
    return t.pages.select("page_id", F.sha2(X.escape_html(F.col("html")).cast("binary"), 256).alias("digest"))


@query(f"""SELECT doc_id, translate(text, '{X.BIDI}', '') = text AS clean, sha256(nfc_normalize(text)) AS nfc_digest FROM documents""")
def bidi_nfc(t):
    text = F.col("text")
    return t.documents.select("doc_id", (X.strip_bidi(text) == text).alias("clean"), F.sha2(X.nfc(text).cast("binary"), 256).alias("nfc_digest"))


@query()  # DuckDB's distance counts bytes
def cer_pairs(t):
    return _turns(t).select("conv_id", "turn", F.round(C.character_error_rate(F.col("text"), F.col("b")), 6).alias("cer"))


def _turns(t):
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("b", after).filter("b IS NOT NULL")


@query()
def wer_pairs(t):
    return _turns(t).select("conv_id", "turn", F.round(C.word_error_rate("text", "b"), 6).alias("wer"))


@query()
def word_diff(t):
    return _turns(t).select("conv_id", "turn", F.inline(C.word_diff("text", "b")))


@query("""
    WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations),
    a AS (SELECT conv_id, word, count(*) AS a FROM w WHERE role = 'user' GROUP BY ALL), b AS (SELECT conv_id, word, count(*) AS b FROM w WHERE role = 'assistant' GROUP BY ALL),
    j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL OUTER JOIN b ON a.conv_id = b.conv_id AND a.word = b.word)
    SELECT conv_id, sum(a)::BIGINT AS n_left, sum(b)::BIGINT AS n_right, sum(least(a, b))::BIGINT AS n_both, round(2.0 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS f1 FROM j GROUP BY 1""")
def multiset_recall(t):
    spoken = t.conversations.select("conv_id", "role", F.explode(X.words(F.col("text"))).alias("word"))
    out = C.multiset_overlap(spoken.filter("role = 'user'"), spoken.filter("role = 'assistant'"), "conv_id", "word")
    return out.withColumn("f1", F.round(C.f1(F.col("n_both"), F.col("n_left"), F.col("n_right")), 6))


@query("""
    WITH a AS (SELECT l_returnflag AS k, l_linenumber AS k2, l_orderkey, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey) AS n FROM lineitem WHERE l_linestatus = 'O'),
    b AS (SELECT l_returnflag AS k, l_linenumber AS k2, l_orderkey, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey) AS n FROM lineitem WHERE l_linestatus = 'F')
    SELECT a.k AS l_returnflag, a.k2 AS l_linenumber, a.l_orderkey, b.l_orderkey AS l_orderkey_right FROM a JOIN b ON a.k = b.k AND a.k2 = b.k2 AND a.n = b.n""")
def greedy_pairs(t):
    rows = t.lineitem.select("l_returnflag", "l_linenumber", "l_orderkey", "l_linestatus")
    left, right = (rows.filter(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("O", "F"))
    return C.fifo_pairs(left, right, ["l_returnflag", "l_linenumber"], "l_orderkey")


@query("""
    WITH s AS (SELECT doc_id, 1 - n_chars % 100 / 100.0 AS a, CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 / 10.0 END AS b, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 / 7.0 END AS c FROM documents)
    SELECT doc_id, round(list_avg(list_filter([a, b, c], lambda x: x IS NOT NULL)), 6) AS fidelity FROM s""")
def fidelity_mean(t):
    key = F.col("doc_id")
    scores = (1 - F.col("n_chars") % 100 / 100, F.when(key % 2 == 0, key % 10 / 10), F.when(key % 3 == 0, key % 7 / 7))
    return t.documents.select("doc_id", F.round(C.mean_of(*scores), 6).alias("fidelity"))


_BOX = "least(embedding[1], embedding[3])::DOUBLE AS l, least(embedding[2], embedding[4])::DOUBLE AS t, greatest(embedding[1], embedding[3])::DOUBLE AS r, greatest(embedding[2], embedding[4])::DOUBLE AS b"


def _box(e: str) -> dict:
    x = [F.get(e, i).cast("double") for i in range(4)]
    return {"left": F.least(x[0], x[2]), "top": F.least(x[1], x[3]), "right": F.greatest(x[0], x[2]), "bottom": F.greatest(x[1], x[3])}


@query(f"""
    WITH v AS (SELECT vec_id, label, {_BOX} FROM embeddings),
    p AS (SELECT x.vec_id AS a, y.vec_id AS b, greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) AS i, (x.r - x.l) * (x.b - x.t) AS ax, (y.r - y.l) * (y.b - y.t) AS ay
          FROM v x JOIN v y ON x.vec_id + 1 = y.vec_id)
    SELECT a, b, round(CASE WHEN ax > 0 AND ay > 0 THEN i / (ax + ay - i) ELSE 0 END, 6) AS iou FROM p""")
def iou_pairs(t):
    a = t.embeddings.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("ea"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "b").select("a", "b", F.round(C.iou(_box("ea"), _box("eb")), 6).alias("iou"))


@query(f"""WITH v AS (SELECT label, {_BOX} FROM embeddings) SELECT label, min(l) AS "left", min(t) AS top, max(r) AS "right", max(b) AS bottom FROM v GROUP BY 1""")
def bbox_union(t):
    box = _box("embedding")
    return t.embeddings.groupBy("label").agg(
        F.min(box["left"]).alias("left"), F.min(box["top"]).alias("top"), F.max(box["right"]).alias("right"), F.max(box["bottom"]).alias("bottom")
    )


@query("""
    WITH h AS (SELECT p_partkey % 40 AS doc, p_partkey AS ord, p_size % 6 + 1 AS level FROM part)
    SELECT doc, ord, level::INT AS level, (SELECT max(x.ord) FROM h x WHERE x.doc = h.doc AND x.ord < h.ord AND x.level < h.level
           ) AS nearest_above FROM h""")
def heading_tree(t):
    rows = t.part.select((F.col("p_partkey") % 40).alias("doc"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 6 + 1).cast("int").alias("level"))
    before = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    parents = [F.max(F.when(F.col("level") < k, F.col("ord"))).over(before) for k in range(1, 7)]
    parent = F.lit(None).cast("long")
    for k, above in enumerate(parents, 1):
        parent = F.when(F.col("level") == k, above).otherwise(parent)
    return rows.select("doc", "ord", "level", parent.alias("nearest_above"))


@query("""
    SELECT event_type, round_even(avg(value), 3) AS mean_value, round_even(median(value) / 10, 0) * 10 AS median_10, max(value) AS largest, count(*) AS samples FROM events GROUP BY 1""")
def edge_aggregate(t):
    return t.events.groupBy("event_type").agg(
        F.bround(F.avg("value"), 3).alias("mean_value"), (F.bround(F.median("value") / 10, 0) * 10).alias("median_10"), F.max("value").alias("largest"), F.count("*").alias("samples")
    )


@query("""SELECT c_custkey, 'doc-' || lpad(c_custkey::VARCHAR, 5, '0') || '_2024-01-01_' || regexp_replace(c_mktsegment, '[^A-Za-z0-9._ -]', '_', 'g') AS name FROM customer""")
def naming_template(t):
    values = {"stem": F.lit("doc"), "n": F.lpad(F.col("c_custkey").cast("string"), 5, "0"), "date": F.lit("2024-01-01"), "title": F.col("c_mktsegment")}
    return t.customer.select("c_custkey", X.expand_name("{stem}-{n}_{date}_{title}", values).alias("name"))


@query()
def glossary_translate(t):
    translated = Q.translate({"the": "der", "and": "und", "of the": "des"})(F.col("text"))
    return t.documents.select("doc_id", F.sha2(translated.cast("binary"), 256).alias("digest"))


@query()
def exact_target_places(t):
    places = M.exact_places("an")(F.col("text"))
    return t.documents.select("doc_id", F.size(places).alias("n"), F.get(places, 0).alias("first")).filter("n > 0")
