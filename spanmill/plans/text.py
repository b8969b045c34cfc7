"""Caption text: normal forms, n-grams, lexicon lookup, tags, ids and templates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon as X
from ..operators import metrics as M
from ..registry import query
from ..sources.adapters import CAP, captions, table
from ..sources.store import stored

NORM = r"""norm AS (SELECT case_id, node, trim(regexp_replace(regexp_replace(regexp_replace(lower(caption), '[-\n\t]', ' ', 'g'), '[^a-z0-9'' ]', '', 'g'), ' +', ' ', 'g')) AS t FROM cap)"""
TOK = f"""WITH {CAP}, {NORM}, tok AS (SELECT case_id, node, list_filter(list_transform(string_split(t, ' '), lambda w: trim(w, '''')), lambda w: w <> '') AS w FROM norm)"""
EDGE = ", ".join(f"'{w}'" for w in T.EDGE_WORDS)
GRAMS = " UNION ALL ".join(f"SELECT case_id, node, unnest(list_distinct(list_transform(generate_series(1, len(w) - {n} + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))) AS gram, {n} AS size FROM tok WHERE len(w) >= {n}" for n in (1, 2, 3))
READ = f"""{TOK}, allg AS ({GRAMS}), g AS (SELECT DISTINCT case_id, node, gram FROM allg WHERE string_split(gram, ' ')[1] NOT IN ({EDGE}) AND string_split(gram, ' ')[-1] NOT IN ({EDGE}) AND length(replace(gram, ' ', '')) >= 2)"""


#: Characters of captions whose phrases a task holds, about.
CHARS_IN_TASK = 4_000_000


def grams(spark, sf_dir, most=3):
    """Two tables (case_id, node, own) of the distinct readable n-grams of each caption: of ids that occur once, of the others.

    An id that occurs once needs no exchange of its grams; only ids are counted.
    """
    cap = captions(spark, sf_dir)
    again = stored(cap.groupBy("case_id").count().where("count > 1").select(F.col("case_id").alias("id")), "ids")
    same = F.col("case_id").eqNullSafe(F.col("id"))
    words = T.tokens(T.normalized(F.col("caption")))
    # Exploded, so that a filter on the grams does not take in what they are made of, once for each word.
    held = lambda c: F.explode(F.array(c))
    own = lambda df: df.select("case_id", "node", held(words).alias("w")).select("case_id", "node", held(T.ngrams(F.col("w"), most)).alias("own"))
    several = own(cap.join(again, same, "left_semi")).groupBy("case_id", "node").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    return own(cap.join(again, same, "left_anti")).where(F.size("own") > 0), several.where(F.size("own") > 0)


def every_gram(spark, sf_dir, most=3):
    """(case_id, node, own): the distinct readable n-grams of each caption."""
    once, several = grams(spark, sf_dir, most)
    return once.union(several)


@query(f"WITH {CAP}, {NORM} SELECT case_id, md5(t) AS digest, length(t) AS n FROM norm")
def str01_caption_normalization(spark, sf_dir):
    t = captions(spark, sf_dir).select("case_id", T.normalized(F.col("caption")).alias("t"))
    return t.select("case_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@query(f"{TOK} SELECT case_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM tok")
def str02_tokens(spark, sf_dir):
    t = captions(spark, sf_dir).select("case_id", T.tokens(T.normalized(F.col("caption"))).alias("w"))
    return t.select("case_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"{READ} SELECT case_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS digest FROM g GROUP BY 1")
def str03_readable_ngrams(spark, sf_dir):
    once, several = grams(spark, sf_dir)
    several = several.groupBy("case_id").agg(F.flatten(F.collect_list("own")).alias("own"))
    g = once.select("case_id", "own").union(several)
    return g.select("case_id", F.size("own").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("own"), "|").cast("binary")).alias("digest"))


@query(f"{READ} SELECT gram, count(*) AS captions, count(DISTINCT node) AS nodes, min(case_id) AS example FROM g GROUP BY 1 HAVING count(*) >= 5")
def str04_phrase_support(spark, sf_dir):
    # Words meet as counts of each task. Phrases of two and three words would hardly be summed there: each three-word one is
    # sent once, to the task of its first two words, and stands for these as well; nothing is sent again to be counted.
    words = every_gram(spark, sf_dir, 1).select("case_id", "node", F.explode("own").alias("gram"))
    spaces = lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit("")))
    head = lambda g: F.substring_index(g, " ", 2)
    # In order, a phrase of two words is followed by those of three that begin with it.
    sent = F.transform("own", lambda g, i: F.when(
        ~((spaces(g) == 1) & F.coalesce(F.startswith(F.get("own", i + 1), F.concat(g, F.lit(" "))), F.lit(False))),
        F.struct(g.alias("sent"), ((spaces(g) == 2) & (F.get("own", i - 1) == head(g))).alias("both")),
    ))
    longer = every_gram(spark, sf_dir, 3).select("case_id", "node", F.array_sort(F.filter("own", lambda g: F.contains(g, F.lit(" ")))).alias("own"))
    longer = longer.select("case_id", "node", F.inline(F.array_compact(sent)))
    chars = captions(spark, sf_dir).agg(F.sum(F.length("caption"))).first()[0] or 0
    longer = longer.withColumn("head", head(F.col("sent"))).repartition(1 + chars // CHARS_IN_TASK, "head")
    longer = longer.select("case_id", "node", "head", F.explode(F.when(F.col("both"), F.array("sent", "head")).otherwise(F.array("sent"))).alias("gram"))

    def supported(g, *keys):
        # By node first, so that nodes are counted without a second copy of all grams.
        g = g.groupBy(*keys, "gram", "node").agg(F.count("*").alias("n"), F.min("case_id").alias("example"))
        g = g.groupBy(*keys, "gram").agg(F.sum("n").alias("captions"), F.count("node").alias("nodes"), F.min("example").alias("example"))
        return g.where("captions >= 5").select("gram", "captions", "nodes", "example")

    return supported(words).union(supported(longer, "head"))


LEM = """v AS (SELECT w, list_distinct(list_filter([w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') END,
  CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] END, CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] || 'e' END, CASE WHEN w LIKE '%ing' AND length(w) >= 6 AND w[-4:-4] = w[-5:-5] THEN w[:-5] END,
  CASE WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] END, CASE WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] || 'e' END, CASE WHEN w LIKE '%ed' AND length(w) >= 5 AND w[-3:-3] = w[-4:-4] THEN w[:-4] END,
  CASE WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] END, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN w[:-2] END], lambda x: x IS NOT NULL)) AS forms FROM (SELECT DISTINCT unnest(w) AS w FROM tok))"""


def distinct_words(spark, sf_dir):
    """(w): the distinct words of all captions."""
    return captions(spark, sf_dir).select(F.explode(T.tokens(T.normalized(F.col("caption")))).alias("w")).distinct()


@query(f"{TOK}, {LEM} SELECT w AS word, array_to_string(list_sort(forms), ',') AS forms FROM v")
def str05_lemma_variants(spark, sf_dir):
    return distinct_words(spark, sf_dir).select(F.col("w").alias("word"), F.array_join(F.array_sort(T.lemmas(F.col("w"))), ",").alias("forms"))


@query(f"""{TOK}, {LEM}, lex AS (SELECT w AS entry FROM v WHERE length(w) BETWEEN 3 AND 6), k AS (SELECT w, f, CASE WHEN f = w THEN 0 ELSE 1 END AS kind FROM (SELECT w, unnest(forms) AS f FROM v))
SELECT w AS word, f AS entry, CASE kind WHEN 0 THEN 'exact' ELSE 'lemma' END AS how FROM k JOIN lex ON f = entry QUALIFY row_number() OVER (PARTITION BY w ORDER BY kind, f) <= 2""")
def str06_lexicon_lookup(spark, sf_dir):
    words = distinct_words(spark, sf_dir)
    lexicon = words.where(F.length("w").between(3, 6)).select(F.col("w").alias("entry"))
    tried = words.select("w", F.explode(T.lemmas(F.col("w"))).alias("entry")).withColumn("kind", (F.col("entry") != F.col("w")).cast("int"))
    found = M.top(tried.join(lexicon.hint("merge"), "entry"), 2, ["w"], F.asc("kind"), F.asc("entry"))
    return found.select(F.col("w").alias("word"), "entry", F.when(F.col("kind") == 0, "exact").otherwise("lemma").alias("how"))


PHRASES = f"""{TOK}, ph AS (SELECT conv_id * 1000 + turn AS id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-\n\t]', ' ', 'g'), '[^a-z0-9'' ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> ''), ' ') AS phrase FROM conversations WHERE text IS NOT NULL),
pw AS (SELECT id, phrase, string_split(phrase, ' ') AS ws FROM ph), sp AS (SELECT id, phrase, -1 AS narrow, 0 AS start, phrase AS part FROM pw""" + "".join(
    f" UNION ALL SELECT id, phrase, {3 - n}, i, array_to_string(ws[i + 1:i + {n}], ' ') FROM (SELECT *, unnest(generate_series(0, len(ws) - {n})) AS i FROM pw WHERE len(ws) >= {n})" for n in (3, 2, 1)
) + """), ps AS (SELECT * FROM sp WHERE narrow IN (-1, 2) OR part <> phrase), v AS (SELECT part AS w, {forms} AS forms FROM (SELECT DISTINCT part FROM ps)),
tr AS (SELECT id, narrow, start, part, unnest(forms) AS term FROM ps JOIN v ON w = part), pl AS (SELECT id, term, CASE WHEN narrow = -1 AND term = part THEN 0 WHEN narrow = -1 THEN 1 WHEN narrow = 2 THEN 4 WHEN term <> part THEN 3 ELSE 2 END AS level,
CASE WHEN narrow = -1 THEN 0 WHEN narrow = 2 THEN 2 ELSE 1 END AS g, narrow, start, CASE WHEN narrow = 2 THEN 0 WHEN term <> part THEN 1 ELSE 0 END AS b FROM tr WHERE term <> ''),
fi AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY id, term ORDER BY g, narrow, start, b, term) = 1),
lex AS (SELECT w AS entry FROM (SELECT DISTINCT unnest(w) AS w FROM tok) WHERE length(w) BETWEEN 4 AND 6 UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM tok) WHERE length(w[i]) BETWEEN 4 AND 6 AND length(w[i + 1]) BETWEEN 4 AND 6)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY g, narrow, start, b, term) AS INT) AS rank, term AS entry, (['exact_phrase', 'simple_lemma_phrase', 'phrase_subspan', 'simple_lemma_subspan', 'token_or_token_lemma'])[level + 1] AS how FROM fi JOIN lex ON entry = term QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, narrow, start, b, term) <= 5"""


@query(PHRASES.replace("{forms}", LEM[LEM.index("list_distinct"):LEM.index(" AS forms")].replace("[w, ", "[part, ").replace(" w ", " part ").replace("(w)", "(part)").replace("(w,", "(part,").replace("w[", "part[")))
def str06_ordered_lookup(spark, sf_dir):
    """The first five entries for each turn: the whole phrase, its parts of three and two words, its words, each with base forms."""
    raw = F.filter(F.split(T.normalized(F.col("text")), " "), lambda w: w != "")
    phrases = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array_join(raw, " ").alias("phrase"))
    texts = captions(spark, sf_dir).select(T.tokens(T.normalized(F.col("caption"))).alias("w"))
    short = lambda c: F.length(c).between(4, 6)
    pairs = texts.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(0))).alias("b")))).where(short("a") & short("b")).select(F.concat_ws(" ", "a", "b").alias("entry"))
    lexicon = distinct_words(spark, sf_dir).where(F.length("w").between(4, 6)).select(F.col("w").alias("entry")).union(pairs)
    return X.looked_up(phrases, lexicon, 5)


TARGETS = {"license": r"licensed under|released under", "contact": r"@mail|555-[0-9]{4}", "secret": r"token ="}


@query(" UNION ALL ".join(f"SELECT '{k}' AS target, doc_id FROM documents WHERE regexp_matches(text, '(?i){p}')" for k, p in TARGETS.items()))
def str07_target_tagging(spark, sf_dir):
    # The registry is a literal list, so that every text is read once.
    tags = F.array_compact(F.array(*[F.when(T.any_of(F.col("text"), [p]), k) for k, p in TARGETS.items()]))
    return table(spark, sf_dir, "documents").select(F.explode(tags).alias("target"), "doc_id")


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)licen[sc]e') AND NOT regexp_matches(text, '(?i)gnu|creative') AS accepted, regexp_matches(text, '(?i)gnu|creative') AS vetoed FROM documents""")
def str08_positive_negative_rule(spark, sf_dir):
    veto = T.any_of(F.col("text"), ["gnu|creative"])
    return table(spark, sf_dir, "documents").select("doc_id", (T.any_of(F.col("text"), ["licen[sc]e"]) & ~veto).alias("accepted"), veto.alias("vetoed"))


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:the|of) [a-z]+ [a-z]+')) AS p FROM documents) SELECT p AS phrase, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 3""")
def str09_phrase_extraction(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("text"), F.lit("(?:the|of) [a-z]+ [a-z]+"), F.lit(0))
    m = table(spark, sf_dir, "documents").select(F.explode(found).alias("phrase"))
    return m.groupBy("phrase").agg(F.count("*").alias("n")).where("n >= 3")


@query("""SELECT page_id, contains(html, '<table') AS has_table, contains(html, '<nav') OR contains(html, '<ul') AS has_menu, contains(lower(html), 'script') AS has_script FROM pages""")
def str10_keyword_tags(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", h.contains("<table").alias("has_table"), (h.contains("<nav") | h.contains("<ul")).alias("has_menu"), F.lower(h).contains("script").alias("has_script"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_')[:48] AS slug FROM pages""")
def str11_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, sha1(page_id || '||' || url)[:12] AS id FROM pages")
def str12_short_hash_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.short_id(F.col("page_id").cast("string"), F.col("url")).alias("id"))


VOCABULARY = "abcdefghijklmnopqrstuvwxyz .,'"


@query(f"""WITH c AS (SELECT item_id, string_split(lower(text)[:30], '') AS c FROM benchmark), i AS (SELECT item_id, list_transform(c, lambda x: CASE WHEN instr('{VOCABULARY.replace("'", "''")}', x) > 0 THEN instr('{VOCABULARY.replace("'", "''")}', x) + 3 ELSE 3 END) AS ids FROM c)
SELECT item_id, array_to_string(list_concat([1], ids, [2], list_transform(generate_series(1, 30 - len(ids)), lambda x: 0)), ' ') AS ids, CAST(len(ids) + 2 AS BIGINT) AS used FROM i""")
def str13_char_tokenizer(spark, sf_dir):
    chars = F.split(F.substring(F.lower("text"), 1, 30), "")
    at = F.transform(chars, lambda c: F.when(F.instr(F.lit(VOCABULARY), c) > 0, F.instr(F.lit(VOCABULARY), c) + 3).otherwise(3))
    own = table(spark, sf_dir, "benchmark").select("item_id", at.alias("ids"))
    ids = F.concat(F.array(F.lit(1)), F.col("ids"), F.array(F.lit(2)), F.array_repeat(F.lit(0), 30 - F.size("ids")))
    return own.select("item_id", F.array_join(ids, " ").alias("ids"), (F.size("ids") + 2).cast("long").alias("used"))


@query("""SELECT event_id, 'user ' || user_id || ' has ' || CASE event_type WHEN 'error' THEN 'an error' ELSE 'a ' || event_type END || CASE WHEN value >= 100 THEN ' of high value' WHEN value >= 20 THEN ' of some value' ELSE '' END
|| ' at hour ' || (epoch_us(ts) // 3600000000 % 24) || CASE WHEN event_type = 'click' THEN ', ' || CAST(floor(value / 10) AS BIGINT) || CASE WHEN floor(value / 10) = 1 THEN ' step' ELSE ' steps' END ELSE '' END AS clause FROM events""")
def str14_template_rendering(spark, sf_dir):
    steps = F.floor(F.col("value") / 10)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) % 24
    kind = F.when(F.col("event_type") == "error", F.lit("an error")).otherwise(F.concat(F.lit("a "), F.col("event_type")))
    size = F.when(F.col("value") >= 100, " of high value").when(F.col("value") >= 20, " of some value").otherwise("")
    count = F.when(F.col("event_type") == "click", F.concat(F.lit(", "), steps.cast("string"), F.when(steps == 1, " step").otherwise(" steps"))).otherwise("")
    clause = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" has "), kind, size, F.lit(" at hour "), hour.cast("string"), count)
    return table(spark, sf_dir, "events").select("event_id", clause.alias("clause"))


@query("""WITH s AS (SELECT p_partkey, 'SIG[' || p_brand || ':' || p_type || '+' || p_name || ':' || p_size || ']' AS sig FROM part), i AS (SELECT p_partkey, unnest(string_split(regexp_extract(sig, '^SIG\\[(.*)\\]$', 1), '+')) AS item FROM s)
SELECT p_partkey, string_split(item, ':')[1] AS key, string_split(item, ':')[2] AS value FROM i""".replace("\\\\", "\\"))
def str15_signature_parse(spark, sf_dir):
    sig = F.concat(F.lit("SIG["), F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit("+"), F.col("p_name"), F.lit(":"), F.col("p_size").cast("string"), F.lit("]"))
    items = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.regexp_extract(sig, r"^SIG\[(.*)\]$", 1), r"\+")).alias("item"))
    return items.select("p_partkey", F.split("item", ":")[0].alias("key"), F.split("item", ":")[1].alias("value"))
