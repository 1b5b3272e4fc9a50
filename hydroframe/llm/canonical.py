"""Mapping of typed place texts to a canonical list of names (problem 5), in SQL only.

Partition-based pigeonhole join: a listed alias, without its type word, is cut into k+1 segments; within k edits at
least one segment stands unchanged in the typed text, at most k places away. Typed texts are reduced to distinct word
windows first, so a name typed a million times is compared once; windows and segments meet in an equality join on the
substring, and pairs are verified by levenshtein. Entries without a verified window come back through an anti join.

Windows are one to one word more than the longest alias has, as typed texts also part words.

Only the clause that names the sampled water is looked at: what follows a relation (before the confluence with,
falling into, after meeting, upstream of, above, ...) names another water or a landmark.

An alias also counts without the h of its inner consonants (sh, ch, th), as such letters are often left out together.

Defined cases: entries without id are left out; null, blank and unreadable texts map to the empty name; of several listed names in the clause the one
with the fewest edits holds, then the leftmost, then the alphabetically first; entries typed twice are mapped twice;
an alias listed for several names belongs to the alphabetically first; an empty list leaves every entry unmatched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from hydroframe.plans.io import only

#: Edits allowed: K for aliases of LONG letters or more, one for those of SHORT or more (two where they swap letters), none below.
K, LONG, SHORT = 2, 8, 5

# Words for kinds of water, as typed.
TYPES = "river riv rvr r drain drn canal cnl khad khadd khud nallah nala nalla nullah choe cho choh choa stream strm str"
# What begins a clause about another place.
RELATIONS = r"\\s(before( the)?( conf(luence|\\.)?)?( with| of)?|after( meeting| conf(luence)?)?|fall(ing|s) (in)?to|joins|joining|into|u/s( of)?|d/s( of)?|up ?stream( of)?|down ?stream( of)?|above|below|near|opposite|opp\\.?|sec\\.?)\\s"
# Landmarks, which may stand before or after the name.
LANDMARKS = "bus stand|sewage works|temple steps|pump house|cattle trough|fish market|leisure garden|sluice gate|check dam|cricket ground|tannery wall|school bridge|rail bridge|ring road culvert|road culvert|old mill|allotments|bridge|culvert|weir|gate|site"

SQL = """
WITH aliases_of AS (
  SELECT stem, min_by(name, struct(folded, name)) AS name, length(stem) AS len, max(words) AS words, CASE WHEN length(stem) >= {short} THEN {k} ELSE 0 END AS edits
  FROM (SELECT name, words, form.stem, form.folded
        FROM (SELECT name, size(filter(split(typeless, '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')) AS words, regexp_replace(typeless, '[^\\\\p{{L}}\\\\p{{N}}]', '') AS written
              FROM (SELECT name, regexp_replace(lower(trim(alias)), '(^|[ -])({any_type})\\\\.?(?=$|[ -])', ' ') AS typeless
                    FROM {aliases} WHERE alias IS NOT NULL AND name IS NOT NULL))
        LATERAL VIEW explode(array(struct(written AS stem, 0 AS folded), struct(regexp_replace(written, '(?<=[a-z][bcdfgjklpstz])h', '') AS stem, 1 AS folded))) f AS form)
  WHERE stem <> '' GROUP BY stem
), parts AS (
  SELECT stem, name, len, edits, i, CAST(floor(i * len / (edits + 1)) AS INT) AS start,
         substring(stem, CAST(floor(i * len / (edits + 1)) AS INT) + 1, CAST(floor((i + 1) * len / (edits + 1)) AS INT) - CAST(floor(i * len / (edits + 1)) AS INT)) AS part
  FROM aliases_of LATERAL VIEW explode(sequence(0, edits)) s AS i
), clauses AS (
  SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(' ', lower(location), ' '),
           '^ [a-z]{{2}}[0-9]+ *- *', ' '), '{relations}.*$', ' '), '\\\\([^()]*\\\\)', ' '), '^[^:]*:', ' '), '(^| )({landmarks})(?=$|[ ,.)/])', ' ')) AS clause
  FROM {entries} WHERE trim(location) <> ''
), tokens AS (
  SELECT entry_id, filter(split(regexp_replace(clause, '/.*$', ' '), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '') AS t
  FROM clauses
), bounds AS (
  SELECT min(len - edits) AS least, max(len + edits) AS most, max(words) + 1 AS words FROM aliases_of
), windows AS (
  SELECT entry_id, place, w
  FROM (SELECT entry_id, p AS place, array_join(slice(t, p, n), '') AS w
        FROM tokens LATERAL VIEW explode(sequence(1, greatest(size(t), 1))) a AS p LATERAL VIEW explode(sequence(1, coalesce((SELECT words FROM bounds), 1))) b AS n
        WHERE p + n - 1 <= size(t))
  WHERE length(w) BETWEEN (SELECT least FROM bounds) AND (SELECT most FROM bounds)
), typed AS (
  SELECT DISTINCT w, length(w) AS len FROM windows
), pieces AS (
  SELECT w, len, at, substring(w, at + 1, n) AS part
  FROM typed LATERAL VIEW explode(sequence(0, len - 1)) a AS at
       LATERAL VIEW explode((SELECT collect_set(length(part)) FROM parts)) b AS n
  WHERE at + n <= len
), verified AS (
  SELECT w, name, stem, levenshtein(w, stem) AS distance
  FROM (SELECT DISTINCT q.w, p.name, p.stem, p.edits
        FROM pieces q JOIN parts p ON q.part = p.part AND abs(q.at - p.start) <= p.edits AND abs(q.len - p.len) <= p.edits)
  WHERE levenshtein(w, stem) <= CASE WHEN length(stem) >= {long} OR array_sort(split(w, '')) = array_sort(split(stem, '')) THEN edits ELSE least(edits, 1) END
), matched AS (
  SELECT x.entry_id, min_by(v.name, struct(v.distance, x.place, v.name)) AS name
  FROM windows x JOIN verified v ON x.w = v.w GROUP BY x.entry_id
)
SELECT entry_id, name FROM matched
UNION ALL
SELECT e.entry_id, '' AS name FROM {entries} e LEFT ANTI JOIN matched m ON e.entry_id = m.entry_id
"""


def map_names(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entry_id, name) of every entry; the empty name where no listed water is named."""
    tag = uuid.uuid4().hex
    views = {"entries": f"entries_{tag}", "aliases": f"aliases_{tag}"}
    entries, aliases = only(entries, "entry_id", "location").where("entry_id is not null"), only(aliases, "alias", "name")
    entries.createOrReplaceTempView(views["entries"])
    aliases.createOrReplaceTempView(views["aliases"])
    text = SQL.format(k=K, long=LONG, short=SHORT, any_type=TYPES.replace(" ", "|"), relations=RELATIONS, landmarks=LANDMARKS, **views)
    return entries.sparkSession.sql(text)


def unmatched(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """The entries whose water is not on the list."""
    return map_names(entries, aliases).where("name = ''").select("entry_id")
