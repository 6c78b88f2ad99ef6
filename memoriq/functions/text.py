"""Text functions: tokens, entity candidates, identifiers, titles, sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{M}\p{N}]+"

# Words that a lexical query leaves out.
QUERY_STOP = [
    "the", "a", "an", "and", "or", "is", "of", "to", "on", "at", "in", "for", "with",
    "what", "was", "were", "did", "do", "does", "i", "my", "me", "we", "our", "you",
    "any", "anything", "about", "that", "this", "those", "these", "be", "been",
    "around", "change", "changed", "changes", "changed?", "work", "work?", "work.",
]

# Words that are no entity candidates of a query.
CANDIDATE_STOP = [
    "the", "a", "an", "this", "that", "these", "those",
    "and", "or", "but", "so", "if", "then", "else", "also", "just", "than",
    "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "done",
    "have", "has", "had", "having", "will", "would", "can", "could", "should", "may", "might", "must",
    "i", "me", "my", "mine", "we", "us", "our", "ours", "you", "your", "yours",
    "he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs",
    "it", "its", "there", "here", "where", "when", "what", "who", "which", "why", "how",
    "to", "of", "in", "on", "at", "by", "for", "with", "from", "about", "into", "over", "under", "up", "down",
    "as", "like", "through", "during", "before", "after", "while", "since", "until", "because",
    "any", "some", "all", "each", "every", "both", "other", "another", "such", "same", "more", "most", "much", "many",
    "few", "several", "no", "not", "yes", "ok", "okay", "well", "really", "very", "only",
    "whom", "whose", "whether",
    "say", "said", "tell", "told", "ask", "asked", "know", "knew", "think", "thought", "feel", "felt",
    "go", "went", "come", "came", "get", "got", "make", "made", "take", "took", "give", "gave",
    "talk", "talked", "write", "wrote", "read", "saw", "see", "seen", "look", "looked",
    "today", "yesterday", "tomorrow", "now", "later", "soon", "ago", "around", "near",
    "thing", "things", "stuff", "something", "nothing", "anything", "everything",
    "people", "person", "everyone", "someone", "anyone",
]

# Capital runs that are no entities.
ACRONYM_NOISE = [
    "I", "II", "III", "IV", "TODO", "FIXME", "WIP", "OK", "YES", "NO", "HTTP", "HTTPS", "URL", "URI", "API",
    "JSON", "XML", "YAML", "CSV", "TSV", "UTF", "ASCII", "BUG", "PR", "CI",
]

# Conventional prefixes of commit subjects and their tags.
PREFIX_TAGS = {
    "feat": "feature", "fix": "bugfix", "refactor": "refactor", "perf": "perf", "docs": "docs",
    "test": "test", "chore": "chore", "ci": "ci", "build": "build", "style": "style",
}

#: Word boundaries spelled out, since engines differ on accented letters.
_EDGE = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
ACRONYM = rf"{_EDGE[0]}([A-Z]{{2,}}[0-9]*(?:[._-][A-Z0-9]+)*){_EDGE[1]}"
CAPITALISED = rf"{_EDGE[0]}([A-Z][A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*){_EDGE[1]}"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits, in order."""
    return F.filter(F.split(F.lower(text), NOT_ALNUM), lambda w: w != "")


def query_tokens(text: Column) -> Column:
    """Distinct search terms: two characters or more, without stop words."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.char_length(w) >= 2) & ~F.array_contains(_words(QUERY_STOP), w)))


def entity_candidates(text: Column, most: int = 12, shortest: int = 4) -> Column:
    """Words of a query that may name an entity, then adjacent pairs of them; the first `most` in order."""
    kept = F.filter(words(text), lambda w: (F.char_length(w) >= shortest) & ~F.array_contains(_words(CANDIDATE_STOP), w))
    pairs = F.zip_with(
        F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.slice(F.array_distinct(F.concat(kept, pairs)), 1, most)


def acronyms(text: Column) -> Column:
    """Capital runs of a text, noise left out, in order and with repeats."""
    return F.filter(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(1)), lambda a: ~F.array_contains(_words(ACRONYM_NOISE), a))


def capitalised_entities(text: Column, noise: list[str] | None = None, hints: Column | None = None) -> Column:
    """Sorted distinct capitalised words and acronyms, 'task N' references and hints; `noise` is compared in lower case."""
    noise = [n.lower() for n in (noise if noise is not None else ACRONYM_NOISE + CANDIDATE_STOP)]
    found = F.concat(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,}[0-9]*)\b"), F.lit(1)))
    kept = F.filter(found, lambda w: ~F.array_contains(_words(noise), F.lower(w)) & ((F.char_length(w) >= 3) | (w == F.upper(w))))
    tasks = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\btask\s+(\d+)\b"), F.lit(1)), lambda n: F.concat(F.lit("task "), n))
    parts = [kept, tasks] + ([hints] if hints is not None else [])
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def contains_word(text: Column, word: str) -> Column:
    import re

    return text.rlike(rf"(?i){_EDGE[0]}{re.escape(word)}{_EDGE[1]}")


def contains_all(text: Column, needles: list[str]) -> Column:
    return F.forall(_words([n.lower() for n in needles]), lambda n: F.contains(F.lower(text), n))


def contains_any(text: Column, needles: list[str]) -> Column:
    return F.exists(_words([n.lower() for n in needles]), lambda n: F.contains(F.lower(text), n))


def sanitised(name: Column) -> Column:
    """Lower case; what isn't letter, digit or underscore becomes one; a leading digit gets one before it."""
    low = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]", "_")
    return F.when(F.coalesce(low, F.lit("")) == "", "default").when(low.rlike("^[0-9]"), F.concat(F.lit("_"), low)).otherwise(low)


def safe_profile_id(profile: Column, backend: Column, dim: Column) -> Column:
    """A name for tables of an embedding profile: its id made safe and six digits of a hash of what defines it."""
    key = F.concat_ws("|", profile, backend, dim.cast("string"))
    return F.concat_ws("_", sanitised(profile), F.substring(F.sha2(key, 256), 1, 6))


def named_uuid(name: Column, namespace: str = "memoriq:tag:") -> Column:
    """The same uuid for the same name: 16 bytes of SHA-256 over namespace and name, with version 5 and variant bits."""
    h = F.sha2(F.concat(F.lit(namespace), name), 256)
    variant = F.element_at(_words(["8", "9", "a", "b"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def note_id(path: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha1(path), 1, 10))


def chunk_id(note: Column, number: Column) -> Column:
    return F.concat(note, F.lit("-c"), F.lpad(number.cast("string"), 2, "0"))


def title_of(text: Column, filename: Column) -> Column:
    """The first level-one heading, or the file name without number, date and extension."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"-?\d{4}-\d{2}-\d{2}$", ""), r"^[0-9]+-", "")
    return F.when(F.coalesce(heading, F.lit("")) != "", heading).otherwise(F.initcap(F.replace(stem, F.lit("-"), F.lit(" "))))


def filename_date(filename: Column) -> Column:
    found = F.regexp_extract(filename, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    return F.when(found != "", found)


def company_of(slug: Column) -> Column:
    """'12-some-company-name-2024-01-31' -> 'some company'; null where the name is no such slug or too short."""
    body = F.regexp_extract(slug, r"^\d+-([a-z0-9-]+?)-\d{4}-\d{2}-\d{2}$", 1)
    parts = F.split(body, "-")
    two = (F.size(parts) >= 2) & (F.char_length(parts[0]) > 2)
    name = F.when(two, F.concat_ws(" ", F.slice(parts, 1, 2))).otherwise(parts[0])
    return F.when(F.char_length(name) >= 5, name)


def head(text: Column, limit: int = 1800, least: int = 120) -> Column:
    """The text up to `limit`, ended after its last full sentence if that leaves more than `least`."""
    cut = F.substring(text, 1, limit)
    full = F.regexp_extract(cut, r"(?s)^(.*)(?:\. |!\n|\?\n)", 1)
    ended = F.when(F.char_length(full) > least, F.substring(cut, F.lit(1), F.char_length(full) + 1)).otherwise(cut)
    return F.when(F.char_length(text) > limit, ended).otherwise(text)


def commit_tags(subject: Column, files: Column) -> Column:
    """'git', the tag of a conventional prefix (or the prefix itself) and the top folders of the files, sorted."""
    prefix = F.when(F.contains(subject, F.lit(":")), F.lower(F.trim(F.substring_index(subject, ":", 1)))).otherwise("")
    known = F.create_map(*[F.lit(x) for kv in PREFIX_TAGS.items() for x in kv])
    own = F.when(prefix != "", F.coalesce(F.try_element_at(known, prefix), prefix))
    tops = F.filter(F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.lower(F.substring_index(f, "/", 1))), lambda t: (t != "") & (t != "."))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit("git")), F.array_compact(F.array(own)), tops)))


def sections(notes: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, section_no, heading, body): level-two sections; what precedes the first has a null heading, empty bodies are dropped."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n##[^\S\n]+(?=\S)")
    rows = notes.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("section_no", "part"))
    first = F.col("section_no") == 0
    heading = F.when(~first, F.trim(F.substring_index("part", "\n", 1)))
    rest = F.when(F.contains("part", F.lit("\n")), F.expr("substring(part, locate('\n', part) + 1)")).otherwise("")
    body = F.regexp_replace(F.when(first, F.col("part")).otherwise(rest), r"^\s+|\s+$", "")
    return rows.select("id", "section_no", heading.alias("heading"), body.alias("body")).where(F.col("body") != "")


def packed_sentences(text: str, limit: int) -> list[str]:
    """Paragraphs up to `limit`; longer ones as packed sentences, longer sentences cut."""
    import re

    if len(text) <= limit:
        return [text]
    out: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        room = ""
        for sentence in [paragraph] if len(paragraph) <= limit else re.split(r"(?<=[.!?])\s+", paragraph):
            if room and len(room) + 1 + len(sentence) > limit:
                out.append(room)
                room = ""
            room = f"{room} {sentence}" if room else sentence
        out.append(room)
    return [piece[i : i + limit] for piece in out for i in range(0, len(piece), limit)]


def size_capped(rows: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = 1800) -> DataFrame:
    """(id, piece_no, piece): texts packed by paragraph, then sentence, then length. Null texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, p) for i, t in zip(b["id"], b["text"], strict=True) for k, p in enumerate(packed_sentences(t, limit))]
            yield pd.DataFrame(out, columns=["id", "piece_no", "piece"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(run, f"id {kind}, piece_no int, piece string")


def spans(rows: DataFrame, pattern: str = ACRONYM, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, value, start_offset, end_offset) of each match, in code points, computed in the JVM from the pieces between matches."""
    r = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    between = F.split("text", pattern)
    r = r.withColumn("m", found).where(F.size("m") > 0).withColumn("b", between)
    return r.select("id", F.posexplode("m").alias("k", "value"), "m", "b").select(
        "id",
        "value",
        (
            F.aggregate(F.slice("b", 1, F.col("k") + 1), F.lit(0), lambda s, x: s + F.char_length(x))
            + F.aggregate(F.slice("m", 1, F.col("k")), F.lit(0), lambda s, x: s + F.char_length(x))
        ).alias("start_offset"),
    ).withColumn("end_offset", F.col("start_offset") + F.char_length("value"))
