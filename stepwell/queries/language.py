"""Queries of vocabulary, votes, spelling, captions and transcripts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepwell.catalog import GOALS, query
from stepwell.functions import scalars, text
from stepwell.operators import index, vocabulary
from stepwell.queries.core import corpus
from stepwell.sources import captions, tables

#: Words with their place in the sentence, and what stands for a tagger: a first word keeps its form as lemma.
_TOK = r""", tok AS (SELECT sentence_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM sent),
tk AS (SELECT sentence_id, pos, word, lower(word) AS surface, CASE WHEN pos = 1 THEN lower(word) ELSE regexp_replace(lower(word), '(en|er|es|s)$', '') END AS lemma, pos > 1 AND regexp_matches(word, '^\p{Lu}') AS is_name FROM tok WHERE word <> '')"""


def tokens(spark, sf_dir):
    s = tables.sentences(spark, sf_dir)
    t = s.select("sentence_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).where("word <> ''")
    low = F.lower("word")
    lemma = F.when(F.col("pos") == 0, low).otherwise(F.regexp_replace(low, "(en|er|es|s)$", ""))
    return t.select("sentence_id", (F.col("pos") + 1).alias("pos"), "word", low.alias("surface"), lemma.alias("lemma"), ((F.col("pos") > 0) & F.col("word").rlike(r"^\p{Lu}")).alias("is_name"))


_VOTE = _TOK + """, ev AS (SELECT surface, lemma, count(*) AS n FROM tk GROUP BY ALL),
lk AS (SELECT DISTINCT surface, regexp_replace(surface, '(en|er|es|s)$', '') AS lemma FROM ev WHERE length(surface) = 7),
b AS (SELECT surface, max(n) FILTER (WHERE lemma = surface) AS failures, arg_min(lemma, (-n, lemma)) AS lemma, max(n) AS n FROM ev GROUP BY surface),
fix AS (SELECT b.surface, b.lemma FROM b LEFT JOIN lk USING (surface) WHERE failures IS NOT NULL AND b.lemma <> b.surface AND (coalesce(lk.lemma = b.lemma, false) OR n >= 4 * failures))"""


def fixes(spark, sf_dir):
    ev = vocabulary.evidence(tokens(spark, sf_dir))
    lookup = ev.where(F.length("surface") == 7).select("surface", F.regexp_replace("surface", "(en|er|es|s)$", "").alias("lemma")).distinct()
    return vocabulary.lemma_corrections(ev, lookup)


@query("majority_lemma_vote", _VOTE + " SELECT surface, lemma FROM fix", corpus=True)
def majority_lemma_vote(spark, sf_dir):
    return fixes(spark, sf_dir)


_NAMES = ", pn AS (SELECT lemma, count(*) FILTER (WHERE is_name) AS names, count(*) FILTER (WHERE NOT is_name) AS content FROM tk GROUP BY lemma HAVING count(*) FILTER (WHERE is_name) > count(*) FILTER (WHERE NOT is_name))"


@query("proper_noun_vote", _TOK + _NAMES + " SELECT lemma, names, content FROM pn", corpus=True)
def proper_noun_vote(spark, sf_dir):
    return vocabulary.proper_nouns(tokens(spark, sf_dir))


@query("normalised_units", _VOTE + _NAMES + ", e AS (SELECT DISTINCT sentence_id, coalesce(fix.lemma, tk.lemma) AS key FROM tk LEFT JOIN fix ON fix.surface = tk.lemma WHERE tk.lemma NOT IN (SELECT lemma FROM pn)) SELECT key, count(*) AS said FROM e GROUP BY key", corpus=True)
def normalised_units(spark, sf_dir):
    """Units after both corpus-wide votes: names dropped, failed lemmas repaired."""
    t = tokens(spark, sf_dir)
    edges = t.select("sentence_id", F.col("lemma").alias("key")).distinct()
    return vocabulary.normalise(edges, vocabulary.proper_nouns(t), fixes(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("said"))


@query("lemma_shares", _TOK + " SELECT pos = 1 AS first, count(*) AS tokens, count(DISTINCT lemma) AS lemmas, round(count(*) FILTER (WHERE lemma = surface)::DOUBLE / count(*)::DOUBLE, 9) AS unchanged FROM tk GROUP BY pos = 1", corpus=True)
def lemma_shares(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("first", F.col("pos") == 1)
    return t.groupBy("first").agg(F.count("*").alias("tokens"), F.count_distinct("lemma").alias("lemmas"), F.round(F.count_if(F.col("lemma") == F.col("surface")) / F.count("*"), 9).alias("unchanged"))


@query("surfaces_first_seen", _TOK + " SELECT lemma, min(surface) AS least, arg_min(surface, (sentence_id, pos)) AS surface FROM tk GROUP BY lemma", corpus=True)
def surfaces_first_seen(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("lemma").agg(F.min("surface").alias("least"), F.min_by("surface", F.struct("sentence_id", "pos")).alias("surface"))


_FW = _TOK + r""", fw AS (SELECT lower(lemma) AS lemma, min(category) AS category, count(*)::BIGINT AS said, array_to_string(list_sort(list_distinct(list(word)))[1:4], ' ') AS forms
FROM (SELECT *, CASE length(surface) WHEN 1 THEN 'article' WHEN 2 THEN 'preposition' WHEN 3 THEN 'pronoun' END AS category FROM tk) WHERE category IS NOT NULL AND regexp_matches(word, '^\p{L}+$') GROUP BY lower(lemma))"""


@query("function_words", _FW + " SELECT lemma, category, said, forms FROM fw ORDER BY said DESC, lemma LIMIT 200", corpus=True)
def function_words(spark, sf_dir):
    t = tokens(spark, sf_dir).select("word", "lemma", F.length("surface").cast("string").alias("tag"), F.lit(1).cast("long").alias("frequency"))
    groups = spark.createDataFrame([("1", "article"), ("2", "preposition"), ("3", "pronoun")], "tag string, category string")
    return vocabulary.function_words(t, groups).limit(200).select("lemma", "category", "said", F.array_join("forms", " ").alias("forms"))


#: Goals written as a list writes them: every third one with an article and a capital, every fifth with an alternative.
_LIST = ", listed AS MATERIALIZED (SELECT CASE WHEN rank % 3 = 0 THEN 'pattern' ELSE 'lemma' END AS kind, CASE WHEN rank % 3 = 0 THEN 'die ' || upper(key[1]) || key[2:] WHEN rank % 5 = 0 THEN key || ', ' || key || 'e' ELSE key END AS key, rank FROM goals WHERE regexp_matches(key, '^\\p{L}{2,}$') AND key[1] <> 'ß' AND key NOT IN ('der', 'die', 'das', 'den', 'dem', 'des', 'ein', 'eine', 'einer', 'einem', 'einen', 'jdm', 'jdn', 'jds', 'etw', 'sich'))".replace("\\\\", "\\")


def listed(spark, sf_dir):
    u, _, goals = corpus(spark, sf_dir)
    g = goals.where(F.col("key").rlike(r"^[^\P{L}ß]\p{L}+$") & ~F.col("key").isin(*text.ARTICLES, *text.ROLES))
    noun, more = F.col("rank") % 3 == 0, F.col("rank") % 5 == 0
    key = F.when(noun, F.concat(F.lit("die "), F.upper(F.substring("key", 1, 1)), F.substr("key", F.lit(2)))).when(more, F.concat("key", F.lit(", "), "key", F.lit("e"))).otherwise(F.col("key"))
    return u, g.select(F.when(noun, "pattern").otherwise("lemma").alias("kind"), key.alias("key"), "rank")


_ALIAS = _LIST + """, named AS MATERIALIZED (SELECT kind, key, unnest(CASE WHEN contains(key, ', ') THEN string_split(key, ', ') WHEN starts_with(key, 'die ') THEN [key[5:]] ELSE [key] END) AS word FROM listed),
fold AS (SELECT lower(word) AS word, min((kind, key)) AS g FROM named GROUP BY lower(word)), ex AS (SELECT word, min((kind, key)) AS g FROM named GROUP BY word),
res AS (SELECT c.key, coalesce(ex.g[2], fold.g[2], c.key) AS new_key FROM cnt c LEFT JOIN ex ON ex.word = c.key LEFT JOIN fold ON fold.word = lower(c.key))"""


@query("unit_resolve_alias", _ALIAS + " SELECT key, new_key FROM res WHERE key <> new_key", corpus=True)
def unit_resolve_alias(spark, sf_dir):
    u, goals = listed(spark, sf_dir)
    return vocabulary.resolve(u, goals, 3000).where("key <> new_key").select("key", "new_key")


@query("covered_forms", _LIST + r", w AS (SELECT kind, key, unnest(regexp_extract_all(key, '[\p{L}-]+')) AS w FROM listed) SELECT DISTINCT unnest([w, lower(w)]) AS form, kind, key FROM w WHERE lower(w) NOT IN ('der', 'die', 'das', 'den', 'dem', 'des', 'ein', 'eine', 'einer', 'einem', 'einen', 'jdm', 'jdn', 'jds', 'etw', 'sich')", corpus=True)
def covered_forms(spark, sf_dir):
    return vocabulary.covered_forms(listed(spark, sf_dir)[1])


def _grams(c, a, b):
    p = f"(repeat(' ', {a}) || lower({c}) || repeat(' ', {b}))"
    return f"list_distinct(list_transform(range(1, length({p}) - 1), lambda i: {p}[i:i+2]))"


_SEARCH = f""", needles AS (SELECT key AS needle FROM goals WHERE rank < 20),
pairs AS (SELECT needle, key, said, {_grams('needle', 2, 1)} AS a, {_grams('key', 2, 1)} AS b FROM needles, cnt),
sc AS (SELECT needle, key, said, CASE WHEN contains(lower(key), lower(needle)) THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS score FROM pairs),
f AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score DESC, said DESC, key) AS place FROM sc WHERE score >= 0.3)"""


@query("trigram_search_jaccard", _SEARCH + " SELECT needle, place::BIGINT AS place, key, said, round(score, 9) AS score FROM f WHERE place <= 20", corpus=True)
def trigram_search_jaccard(spark, sf_dir):
    u, _, goals = corpus(spark, sf_dir)
    needles = goals.where("rank < 20").select(F.col("key").alias("needle"))
    f = vocabulary.search(index.unit_counts(u), needles)
    return f.select("needle", F.col("place").cast("long").alias("place"), "key", "said", F.round("score", 9).alias("score"))


@query(
    "trigram_match_dice",
    rf""", bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS surface FROM benchmark),
sg AS (SELECT surface, {_grams('surface', 2, 2)} AS a FROM bw), eg AS (SELECT key AS entry, {_grams('key', 2, 2)} AS b FROM goals),
sx AS (SELECT surface, len(a) AS na, unnest(a) AS g FROM sg), ex AS (SELECT entry, len(b) AS nb, unnest(b) AS g FROM eg),
p AS (SELECT surface, entry, 2.0::DOUBLE * count(*) / (any_value(na) + any_value(nb))::DOUBLE AS score FROM sx JOIN ex USING (g) GROUP BY surface, entry),
r AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY score DESC, entry) AS place FROM p WHERE score >= 0.6) SELECT surface, entry, round(score, 9) AS score FROM r WHERE place = 1""",
    corpus=True,
)
def trigram_match_dice(spark, sf_dir):
    """The listed goal that each word of the benchmark's texts is closest to."""
    _, _, goals = corpus(spark, sf_dir)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    m = vocabulary.fuzzy_match(tables.table(spark, sf_dir, "benchmark").select(words.alias("surface")), goals.select(F.col("key").alias("entry")), GOALS)
    return m.select("surface", "entry", F.round("score", 9).alias("score"))


@query("off_target", ", terms AS (SELECT list(lower(key)) AS t FROM goals WHERE rank < 30) SELECT doc_id, len(list_filter(t, lambda x: contains(lower(text), x[1:greatest(4, length(x) - 2)]))) > 0 AS on_target FROM documents, terms", corpus=True)
def off_target(spark, sf_dir):
    """Whether each text says any of a short list of terms, by their starts."""
    _, _, goals = corpus(spark, sf_dir)
    terms = goals.where("rank < 30").agg(F.collect_list(F.lower("key")).alias("t"))
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(terms))
    return d.select("doc_id", text.says(F.col("text"), F.col("t")).alias("on_target"))


@query("word_mentions", r"SELECT role, count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)')) AS the, count(*) AS turns FROM conversations GROUP BY role")
def word_mentions(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count_if(text.mentions(F.lower("text"), "the")).alias("the"), F.count("*").alias("turns"))


def lines(spark, sf_dir):
    """Conversation turns as caption lines: four seconds apart, every other without a length of its own."""
    c = tables.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("nr"), F.col("turn").alias("line_id"), (F.col("turn") * 4.0 + F.col("turn") % 3).alias("start_time"), F.when(F.col("turn") % 2 == 0, 0.0).otherwise(2.5).alias("duration"), F.col("text").alias("content"))


_LINES = "WITH lines AS (SELECT conv_id AS video_id, turn AS nr, turn::DOUBLE * 4.0::DOUBLE + (turn % 3)::DOUBLE AS start_time, CASE WHEN turn % 2 = 0 THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END AS duration, text AS content FROM conversations)"


@query("cue_length", _LINES + ", n AS (SELECT *, lead(start_time) OVER (PARTITION BY video_id ORDER BY nr) AS nxt, CASE WHEN video_id % 3 = 0 THEN 40.0::DOUBLE END AS whole FROM lines) SELECT video_id, nr, CASE WHEN duration > 0 THEN duration WHEN nxt IS NOT NULL THEN greatest(0.0::DOUBLE, nxt - start_time) WHEN whole > 0 THEN greatest(0.0::DOUBLE, whole - start_time) ELSE 2.0::DOUBLE END AS duration FROM n")
def cue_length(spark, sf_dir):
    return captions.cue_lengths(lines(spark, sf_dir), F.when(F.col("video_id") % 3 == 0, 40.0)).select("video_id", "nr", "duration")


@query("vtt_overlap_trim", _LINES + ", c AS (SELECT *, start_time + 1.0::DOUBLE + (length(content) % 7)::DOUBLE AS end_time FROM lines), t AS (SELECT *, greatest(start_time, coalesce(max(end_time) OVER (PARTITION BY video_id ORDER BY start_time, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS s FROM c) SELECT video_id, nr, s AS start_time, end_time FROM t WHERE end_time > s")
def vtt_overlap_trim(spark, sf_dir):
    c = lines(spark, sf_dir).withColumn("end_time", F.col("start_time") + 1.0 + F.length("content") % 7)
    return captions.without_overlap(c).select("video_id", "nr", "start_time", "end_time")


@query("nearest_cue", _LINES + ", t AS (SELECT *, (video_id % 23)::DOUBLE AS sec FROM lines) SELECT video_id, arg_min(nr, (abs(start_time - sec), nr)) AS nearest, max(nr) FILTER (WHERE start_time <= sec) AS current FROM t GROUP BY video_id")
def nearest_cue(spark, sf_dir):
    """The cue whose start is nearest a moment (the first of equals), and the one that has begun last by then."""
    t = lines(spark, sf_dir).withColumn("at", (F.col("video_id") % 23).cast("double"))
    near = F.min_by("nr", F.struct(F.abs(F.col("start_time") - F.col("at")), "nr"))
    return t.groupBy("video_id").agg(near.alias("nearest"), F.max(F.when(F.col("start_time") <= F.col("at"), F.col("nr"))).alias("current"))


@query("punctuation_gate", r"SELECT conv_id AS video_id, count(*) AS lines, round(count(*) FILTER (WHERE regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?]$'))::DOUBLE / count(*)::DOUBLE, 9) AS punctuation, CASE WHEN count(*) < 2 THEN 'too-short' WHEN count(*) FILTER (WHERE regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?]$'))::DOUBLE / count(*)::DOUBLE < 0.9 THEN 'unpunctuated' ELSE 'ok' END AS verdict FROM conversations GROUP BY conv_id")
def punctuation_gate(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").withColumn("ends", F.regexp_replace("text", r"\s+$", "").rlike(r"[.!?]$"))
    g = c.groupBy(F.col("conv_id").alias("video_id")).agg(F.count("*").alias("lines"), (F.count_if("ends") / F.count("*")).alias("p"))
    return g.select("video_id", "lines", F.round("p", 9).alias("punctuation"), F.when(F.col("lines") < 2, "too-short").when(F.col("p") < 0.9, "unpunctuated").otherwise("ok").alias("verdict"))


@query("track_judgement")
def track_judgement(spark, sf_dir):
    return captions.judge(lines(spark, sf_dir))


_DE = "ich|und|das|nicht|ist|die|der|wir|auch|sehr|aber|mit|für|sich|noch|schon|wenn|dass|man"
_EN = "the|and|is|you|that|with|for|have|this|are|was|were|they|there|about|would"
_COUNT = lambda ws: f"len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({', '.join(repr(w) for w in ws.split('|'))})))"


@query("transcript_language", f"WITH n AS (SELECT conv_id, {_COUNT(_DE)} AS de, {_COUNT(_EN)} AS en FROM conversations) SELECT CASE WHEN de > en THEN 'de' WHEN en > de THEN 'en' ELSE '?' END AS language, count(*) AS lines, count(DISTINCT conv_id) AS files FROM n GROUP BY 1")
def transcript_language(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").withColumn("language", text.language(F.col("text")))
    return c.groupBy("language").agg(F.count("*").alias("lines"), F.count_distinct("conv_id").alias("files"))


@query("transcript_groups", r"""WITH raw AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS nr, trim(line) AS line FROM raw WHERE trim(line) <> ''),
g AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '[.!?…][''"»)\]]?$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM l)
SELECT conv_id, grp::BIGINT AS nr, string_agg(line, ' ' ORDER BY nr) AS text FROM g GROUP BY conv_id, grp""")
def transcript_groups(spark, sf_dir):
    """Wrapped lines as sentences, one for each end mark."""
    c = tables.table(spark, sf_dir, "conversations")
    raw = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    nr = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "pos")) - 1
    s = captions.transcript_sentences(raw.select("conv_id", nr.alias("nr"), "line"), "conv_id")
    return s.select("conv_id", F.col("nr").cast("long").alias("nr"), "text")


@query("caption_join", "SELECT c.conv_id, d.source AS channel, c.turn, c.text FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE d.lang IN ('en', 'de') AND c.role <> 'system'")
def caption_join(spark, sf_dir):
    """Caption lines of videos in wanted languages: both filters reach the scans."""
    c = tables.table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "text")
    d = tables.table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("conv_id"), F.col("source").alias("channel"))
    return c.join(d, "conv_id").select("conv_id", "channel", "turn", "text")


@query("merge_correct")
def merge_correct(spark, sf_dir):
    return captions.reassemble(lines(spark, sf_dir)).select("video_id", "nr", "text", F.size("source_ids").alias("sources"))


@query("align_words")
def align_words(spark, sf_dir):
    l = captions.cue_lengths(lines(spark, sf_dir), F.lit(None).cast("double"))  # noqa: E741
    return captions.align(l, captions.reassemble(l)).select("video_id", "nr", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


@query("word_times", r""", t AS (SELECT sentence_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM sent), x AS (SELECT * FROM t WHERE w <> '')
SELECT sentence_id, pos::BIGINT AS pos, round(4.0::DOUBLE * (sum(length(w)) OVER (PARTITION BY sentence_id ORDER BY pos))::DOUBLE / (sum(length(w)) OVER (PARTITION BY sentence_id))::DOUBLE, 6) AS ends FROM x""", corpus=True)
def word_times(spark, sf_dir):
    """A line's four seconds shared among its words by length: running sums inside each line's array, no shuffle."""
    s = tables.sentences(spark, sf_dir)
    w = F.filter(F.transform(F.split("text", " "), lambda x, i: F.struct(x.alias("w"), (i + 1).cast("long").alias("pos"))), lambda x: x["w"] != "")
    s = s.select("sentence_id", F.explode(F.array(w)).alias("ws"))
    s = s.select("sentence_id", "ws", F.length(F.array_join(F.transform("ws", lambda x: x["w"]), "")).alias("total"))
    each = s.select("sentence_id", "total", F.posexplode("ws").alias("i", "x"))
    run = F.sum(F.length("x.w")).over(W.partitionBy("sentence_id").orderBy("i"))
    return each.select("sentence_id", F.col("x.pos").alias("pos"), F.round(4.0 * run / F.col("total"), 6).alias("ends"))


_CH = "WITH d AS (SELECT source, doc_id, n_chars::DOUBLE / 15.0::DOUBLE AS secs, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)"


@query("chapter_offsets", _CH + ", o AS (SELECT source, doc_id, coalesce(sum(secs) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS at FROM d), s AS (SELECT *, floor(round(at, 6))::BIGINT AS t FROM o) SELECT source, doc_id, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, (t % 3600) // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS chapter FROM s".replace(" AS at FROM", " AS sec FROM").replace("round(at, 6)", "round(sec, 6)"))
def chapter_offsets(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / F.lit(15.0)).alias("secs"))
    before = F.coalesce(F.sum("secs").over(W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return d.select("source", "doc_id", scalars.chapter_clock(F.round(before, 6)).alias("chapter"))


@query("episode_chunks", _CH + " SELECT source, ((rn - 1) // 50)::BIGINT AS episode, count(*) AS parts, round(sum(secs), 6) AS seconds FROM d GROUP BY ALL")
def episode_chunks(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / F.lit(15.0)).alias("secs"))
    d = d.withColumn("episode", F.floor((F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1) / 50))
    return d.groupBy("source", "episode").agg(F.count("*").alias("parts"), F.round(F.sum("secs"), 6).alias("seconds"))


@query("sense_shift", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS stated FROM conversations")
def sense_shift(spark, sf_dir):
    """A sense is stated only where it differs from the one before."""
    c = tables.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", (~F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")).eqNullSafe(F.col("role"))).alias("stated"))


@query("page_of_rows", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET 80")
def page_of_rows(spark, sf_dir):
    """The third page of forty: pages are the feature."""
    return tables.table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").offset(80).limit(40).select("doc_id", "source")
