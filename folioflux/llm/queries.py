"""The registered queries of the text operators, each over its whole table, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflux.llm import bpe, chat, clusters, decontaminate, importance, licenses, packing, phrases, pii, repetition, secrets, simhash, substring
from folioflux.llm.rows import read

WORDS = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# -- 1: tool calls ----------------------------------------------------------------------

SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query", "limit"]},
    "translate": {"type": "object", "properties": {"text": {"type": "string"}, "target": {"type": "string", "enum": ["de", "en", "fr"]}},
                  "required": ["target", "text"], "additionalProperties": False},
    "count": {"type": "object", "properties": {"text": {"type": "string"}, "unit": {"type": "string"}}, "required": ["text", "unit"]},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The turns as tool traffic: a user turn calls a tool, the assistant turn after it is the result.

    A call refers to the turn of half its number, where that was a call.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    size = F.length(text)
    name = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("count")), (F.pmod(size, F.lit(3)) + 1).cast("int"))
    arguments = F.when(name == "search", F.to_json(F.struct(text.alias("query"), F.pmod(size, F.lit(7)).alias("limit")))) \
        .when(name == "translate", F.to_json(F.struct(text.alias("text"), F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "xx")]), (F.pmod(turn, F.lit(3)) + 1).cast("int")).alias("target")))) \
        .otherwise(F.to_json(F.struct(text.alias("text"), F.when(F.pmod(size, F.lit(2)) == 0, F.lit("word")).alias("unit"))))
    ident = lambda t: F.concat(F.lit("c"), t.cast("string"))
    after = F.when(turn > 0, F.array(ident(F.floor(turn / 2)))).otherwise(F.array().cast("array<string>"))
    call = F.struct(F.array(F.struct(ident(turn).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls"))
    result = F.struct(ident(turn - 1).alias("tool_call_id"), text.alias("content"))
    return conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.to_json(call)).when(F.col("role") == "assistant", F.to_json(result)).alias("text"))


def op1_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.parse_messages(tool_messages(read(spark, sf_dir, "conversations")))
    return chat.link_tool_calls(calls, results, SCHEMAS)


OP1 = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
calls AS (SELECT *, CASE size % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'count' END AS name FROM t WHERE role = 'user'),
results AS (SELECT conv_id, turn - 1 AS call, turn, text FROM t WHERE role = 'assistant'),
edges AS (SELECT c.conv_id, c.turn, p.turn AS parent FROM calls c JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn // 2 AND c.turn > 0),
lv AS (SELECT conv_id, turn, 0 AS level FROM calls WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM edges)
  UNION ALL SELECT e.conv_id, e.turn, lv.level + 1 FROM edges e JOIN lv ON lv.conv_id = e.conv_id AND lv.turn = e.parent),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.call) AS n, c.turn IS NOT NULL AS called, r.call IS NOT NULL AS answered,
  coalesce(c.turn, r.turn) AS position, c.name, c.size, c.text, r.text AS content FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.call)
SELECT j.conv_id, 'c' || n AS call_id, CASE WHEN NOT called THEN 'no_call' WHEN NOT answered THEN 'no_result' ELSE 'linked' END AS status,
  lv.level, position, name,
  CASE WHEN name = 'search' AND size % 7 = 0 THEN 'arguments.limit is too small'
    WHEN name = 'translate' AND n % 3 = 2 THEN 'arguments.target is not allowed'
    WHEN name = 'count' AND size % 2 = 1 THEN 'arguments.unit is missing' END AS problem,
  '{"after":[' || CASE WHEN called AND n > 0 THEN '"c' || (n // 2) || '"' ELSE '' END || '],"arguments":' ||
  CASE name WHEN 'search' THEN '{"limit":' || (size % 7) || ',"query":' || to_json(j.text)::VARCHAR || '}'
    WHEN 'translate' THEN '{"target":"' || ['de', 'en', 'xx'][n % 3 + 1] || '","text":' || to_json(j.text)::VARCHAR || '}'
    WHEN 'count' THEN '{"text":' || to_json(j.text)::VARCHAR || CASE WHEN size % 2 = 0 THEN ',"unit":"word"' ELSE '' END || '}' ELSE 'null' END ||
  ',"id":"c' || n || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical
FROM j LEFT JOIN lv ON called AND lv.conv_id = j.conv_id AND lv.turn = j.n"""

# -- 2: secrets -------------------------------------------------------------------------


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.labels(base), 256).alias("base_sha256"), secrets.labels(F.col("secrets")).alias("spans"))


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_")) + "?" + _either("key")
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _places(pattern: str, kind: int, keep: str, source: str = "docs") -> str:
    return f"""SELECT doc_id, {kind} AS kind, s AS start, s + length(hit) AS "end", hit FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(hit := hits[i],
    s := (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT)), recursive := true)
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM {source})) WHERE {keep}"""


_SINGLE = "regexp_full_match(hit, '[a-z0-9]+|[A-Z0-9]+')"
# Blanked: each character of a base span or of a segment with a sample word is a space.
OP2 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_places(_ASSIGN, 0, f"length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6")}
  UNION ALL {_places("AKIA[A-Z0-9]+", 1, "length(hit) >= 20")}
  UNION ALL {_places("[0-9a-f]{24,}", 2, "true")}),
blank AS (SELECT DISTINCT doc_id, unnest(range(start, "end")) AS i FROM (SELECT * FROM base
  UNION ALL {_places("[A-Za-z0-9+]*(?i:example|sample|placeholder|xxxx)[A-Za-z0-9+]*", 3, "true")})),
chars AS (SELECT doc_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM docs WHERE doc_id IN (SELECT doc_id FROM blank))),
rest AS (SELECT doc_id, text FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM blank)
  UNION ALL SELECT doc_id, string_agg(CASE WHEN b.i IS NULL THEN c ELSE ' ' END, '' ORDER BY chars.i) FROM chars LEFT JOIN blank b USING (doc_id, i) GROUP BY doc_id),
runs AS ({_places(secrets.CANDIDATE, 3, "true", "rest")}),
parts AS (SELECT * FROM runs UNION ALL SELECT DISTINCT p.* FROM ({_places(secrets.SEGMENT, 4, _SINGLE, "rest")}) p JOIN runs r ON r.doc_id = p.doc_id AND r.start <= p.start AND p."end" <= r."end" AND p.hit <> r.hit),
candidates AS (SELECT * FROM parts
  WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_full_match(hit, '[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}')),
windows AS (SELECT doc_id, kind, start, hit, substr(hit, unnest(range(1, length(hit) - 18)), 20) AS w FROM candidates),
bits AS (SELECT doc_id, kind, start, {round(secrets.math.log2(20) * 1e6)} - min(list_sum(list_transform(list_distinct(string_split(w, '')),
    lambda c: {secrets.N_LOG_N}[20 - length(replace(w, c, '')) + 1]))) // 20 AS bits FROM windows GROUP BY ALL),
reached AS (SELECT c.* FROM candidates c JOIN bits USING (doc_id, kind, start)
  WHERE bits >= CASE WHEN regexp_full_match(hit, '[0-9a-fA-F]+') THEN {round(secrets.HEX_BITS * 1e6)} WHEN {_SINGLE} THEN {round(secrets.SINGLE_BITS * 1e6)} ELSE {round(secrets.MIXED_BITS * 1e6)} END),
entropy AS (SELECT doc_id, 3 AS kind, start, "end", hit FROM reached p WHERE kind = 3
  OR NOT EXISTS (SELECT 1 FROM reached r WHERE r.kind = 3 AND r.doc_id = p.doc_id AND r.start <= p.start AND p."end" <= r."end")),
every AS (SELECT * FROM base UNION ALL SELECT * FROM entropy),
named AS (SELECT *, {secrets.KINDS}[kind + 1] || ':' || start || ':' || "end" AS label FROM every),
joined AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
  string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(label, ',' ORDER BY start, kind) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (doc_id)"""

# -- 3: substrings ----------------------------------------------------------------------


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN again USING (g)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

# -- 4: benchmark -----------------------------------------------------------------------


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '{PLAIN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({LOWERED}, ''), '{PLAIN}') AS w FROM benchmark),
p AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM p))),
hits AS (SELECT doc_id, i, size, item FROM win JOIN p USING (size, g)),
n AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""

# -- 5: personal data -------------------------------------------------------------------

KEY = "folioflux-surrogates"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.replace_entities(docs, KEY)
    count = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("long")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"),
                        *[count(k).alias(f"n_{k}") for k in pii.KINDS], "text")

# -- 6: packing -------------------------------------------------------------------------


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(read(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

# -- 7: resampling ----------------------------------------------------------------------


def op7_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
    return importance.resample(read(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")

# -- 8: quality rules -------------------------------------------------------------------


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


def _covered(size: int) -> str:
    return f"""SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {size})) AS k FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d))) WHERE n > 1) GROUP BY doc_id"""


OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
base AS ({_covered(repetition.BASE_WINDOW)}), rep AS ({_covered(repetition.LEAST_REPEAT)}), long AS ({_covered(repetition.LONGEST + 1)}),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')))
    - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')))))::BIGINT AS n_dup_lines,
  coalesce(base.n, 0)::BIGINT AS n_repeat_words, coalesce(rep.n, 0)::BIGINT AS covered_words, long.n IS NULL AS short
  FROM d LEFT JOIN base USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN long USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND covered_words <= {repetition.COVERED}::DOUBLE * n_words AND short AS kept, covered_words FROM f"""

# -- 9: licenses ------------------------------------------------------------------------


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    named = lambda column: F.array_sort(F.array_distinct(column))
    starts = F.transform("phrases", lambda p: p["start"].cast("long"))
    base, more = F.transform("phrases", lambda p: p["label"]), F.transform("templates", lambda p: p["label"])
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), F.array_join(named(base), ",").alias("base_labels"),
                        F.array_join(named(F.concat(base, more)), ",").alias("labels"), "score")


def _some(least: int, most: int) -> str:
    return f"(?: [^ ]+){{{least},{most}}}"


# The wording of the licenses as the SQL looks for it, lower-cased words with a space before each.
_MIT = (" permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?(?: the software)? to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice(?: including the next"
        " paragraph)? shall be included in all copies or substantial portions of the software")
_MIT_END = (" the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular"
            f" purpose and noninfringement in no event shall{_some(1, 12)} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising"
            " from out of or in connection with the software or the use or other dealings in the software")
_FEE = " permission to use copy modify(?: and)?(?: or)? distribute this software for any purpose with or without fee is hereby granted"
_FEE_END = (f" the software is provided as is and{_some(1, 12)}(?: disclaims)?(?: disclaim)? all warranties with regard to this software including all implied warranties of merchantability"
            f" and fitness in no event shall{_some(1, 12)} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or"
            " profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software")
_BSD = (" redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: 1)? redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer(?: 2)? redistributions in binary form must reproduce the above copyright notice this"
        " list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution")
_BSD_NAMES = (f"(?: 3)?(?: 4)? neither the name of{_some(1, 12)} nor the names of(?: its)?(?: their)?(?: any)? contributors may be used to endorse or promote products derived from this software"
              " without specific prior written permission")
_BSD_ADS = ("(?: 3)? all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed"
            f" by{_some(1, 16)}")
_BSD_END = (f" this software is provided by{_some(1, 16)} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a"
            f" particular purpose are disclaimed in no event shall{_some(1, 16)} be liable for any direct indirect incidental special exemplary or consequential damages including but not"
            " limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract"
            " strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")


def _gnu(kind: str) -> str:
    return (f" you can redistribute it and or modify it under the terms of the gnu{kind} general public license as published by the free software foundation(?: either)? version{_some(1, 2)}"
            f" of the license(?: or at your option any later version)?{_some(1, 6)} is distributed in the hope that it will be useful but without any warranty without even the implied"
            f" warranty of merchantability or fitness for a particular purpose see the gnu{kind} general public license for more details you should have received a copy of the gnu{kind}"
            f" general public license along with{_some(1, 6)} if not{_some(1, 24)}")


def _attribution(terms: str) -> str:
    return f" licensed under a creative commons attribution{terms}(?: 3 0)?(?: 4 0)?(?: international)?(?: unported)? license"


WORDING = {
    "mit": _MIT + _MIT_END, "json": _MIT + " the software shall be used for good not evil" + _MIT_END,
    "isc": _FEE + " provided that the above copyright notice and this permission notice appear in all copies" + _FEE_END, "0bsd": _FEE + _FEE_END,
    "bsd-2": _BSD + _BSD_END, "bsd-3": _BSD + _BSD_NAMES + _BSD_END, "bsd-4": _BSD + _BSD_ADS + _BSD_NAMES + _BSD_END,
    "apache-2": (f" licensed under the apache license version 2 0 the license{_some(0, 1)} you may not use(?: this file)?(?: this work)? except in compliance with the license you may obtain"
                 f" a copy of the license at{_some(1, 12)} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
                 " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    "gpl": _gnu(""), "lgpl": _gnu(" lesser"), "agpl": _gnu(" affero"),
    "mpl-2": (" this source code form is subject to the terms of the mozilla public license(?: v 2 0)? if a copy of the mpl was not distributed with this file you can obtain one"
              " at(?: http)?(?: https)? mozilla org mpl 2 0"),
    "cc-by": _attribution(""), "cc-by-sa": _attribution(" sharealike"), "cc-by-nc": _attribution(" noncommercial"), "cc-by-nd": _attribution(" noderivatives"),
    "cc-by-nc-sa": _attribution(" noncommercial sharealike"), "cc-by-nc-nd": _attribution(" noncommercial noderivatives"),
    "cc0": f"(?: to the extent possible under law)?{_some(0, 6)} has waived all copyright and related or neighboring rights(?: to this work)?",
}


def _op9() -> str:
    at = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + {len(p.split())}], ' ') = '{p}')) AS i FROM d"
        for p, label in licenses.PHRASES.items())
    more = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM t WHERE regexp_matches(s, '{words}(?: |$)')" for label, words in WORDING.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '{PLAIN}') AS w FROM documents),
t AS (SELECT doc_id, ' ' || array_to_string(w, ' ') AS s FROM d), base AS ({at}), more AS ({more}),
b AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
m AS (SELECT DISTINCT doc_id FROM more),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN m.doc_id IS NOT NULL THEN 1.0 WHEN b.doc_id IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN a USING (doc_id)"""

# -- 10: near duplicates ----------------------------------------------------------------


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- 11: phrases ------------------------------------------------------------------------


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(coalesce({LOWERED}, ''), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, g, size, count(*) AS f FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size)))
  GROUP BY lang, g, size HAVING count(*) >= 30),
c AS (SELECT lang, g, string_split(g, ' ') AS w, size, f AS a FROM f WHERE size > 1),
cuts AS (SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.x JOIN f y ON y.lang = c.lang AND y.g = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
around AS (SELECT lang, g, max(a) AS m FROM (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS g FROM (
    SELECT lang, a, w, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM c))) GROUP BY lang, g),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.g = b.g WHERE o.m IS NULL OR 100::HUGEINT * o.m < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

# -- 12: clusters -----------------------------------------------------------------------


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12(k: int = 16, rounds: int = 3) -> str:
    near = lambda c: f"""SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT v.*, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))::BIGINT AS d FROM v CROSS JOIN c{c} c) GROUP BY r"""  # noqa: E731
    parts = []
    for i in range(rounds + 1):
        parts.append(f"a{i} AS ({near(i)})")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (SELECT c.c, coalesce(any_value(x.v), c.v) AS v FROM c{i} c LEFT JOIN (
  SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (
    SELECT m.c AS c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) x ON x.c = c.c GROUP BY c.c, c.v)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v QUALIFY c < {k}),
{", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)},
i AS (SELECT m.c AS c, sum(m.d)::BIGINT AS s FROM a{rounds} GROUP BY 1)
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, i.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM i) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.c = a.m.c JOIN c{rounds} c ON c.c = a.m.c"""

# -- 13: encoding -----------------------------------------------------------------------


def op13_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    tokens = bpe.encode(read(spark, sf_dir, "documents"), path, keep=["doc_id"])
    tokens = tokens.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return bpe.decode(tokens, path, keep=["doc_id", "n_tokens", "ids_sha256"]) \
        .select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tool_links, op2_secrets, op3_substrings, op4_decontaminate, op5_surrogates, op6_packing, op7_resample,
                            op8_repetition, op9_licenses, op10_simhash, op11_phrases, op12_clusters, op13_encoding)}
ORACLES = {"op1_tool_links": OP1, "op2_secrets": OP2, "op3_substrings": OP3, "op4_decontaminate": OP4, "op8_repetition": OP8, "op9_licenses": _op9(),
           "op11_phrases": OP11, "op12_clusters": _op12()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
