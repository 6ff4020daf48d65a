"""Words, names and features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that begin a feature.
VERBS = """
get set new create delete remove update handle process validate parse format convert build init close open read write send
receive start stop run execute check is has can should find search lookup save load persist encode decode marshal unmarshal
register add make do list count reset flush sync fetch put patch apply resolve notify emit on to from with ensure assert
test bench serve listen connect disconnect subscribe unsubscribe publish lock unlock wait signal log print render draw sort
filter map reduce merge split join append insert pop push peek scan walk visit traverse compute calculate measure wrap
unwrap extract inject index reindex rebuild refresh compile transform configure setup teardown destroy dispose release
acquire allocate free enable disable toggle show hide expand collapse match compare diff clone copy move rename swap trim
strip clean sanitize normalize flatten chunk embed query watch poll dial accept bind attach detach mount unmount
""".split()
#: Verbs that say little, so the object names the cluster.
GENERIC_VERBS = ["get", "set", "do", "handle", "process", "run", "create", "new"]
FEATURE_WORDS = 4


def query_words(query: str) -> list[str]:
    """Lower-cased words of at least two bytes, repeats included."""
    return [w for w in query.lower().split() if len(w.encode()) >= 2]


def text_score(content: Column, words: list[str]) -> Column:
    """Share of the query words that the content contains, as substrings."""
    if not words:
        return F.lit(0.0).cast("float")
    low = F.lower(content)
    hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words[1:]), F.when(F.contains(low, F.lit(words[0])), 1).otherwise(0))
    return (hits / F.lit(len(words))).cast("float")


def normalize_words(s: Column) -> Column:
    """Distinct lower-cased words between - _ / space . @, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(s), r"[-_/ .@]"), lambda w: w != ""))


def split_name(s: Column) -> Column:
    """Words of a camel, Pascal, snake or kebab case name; runs of capitals stay together."""
    x = F.regexp_replace(s, r"(?<=[\p{L}\p{Nd}&&[^\p{Lu}]])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(x, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def atomic_feature(name: Column) -> Column:
    """Verb and object words of a symbol name, e.g. "handle request"; "operate" where no verb is known."""

    def feature(words: Column) -> Column:
        at = F.array_position(F.transform(words, lambda w: w.isin(VERBS)), F.lit(True)).cast("int")
        return F.when(F.size(words) == 0, F.lit("unknown")).otherwise(_once(at, lambda a: F.array_join(F.slice(chosen(words, a), 1, FEATURE_WORDS), " ")))

    def chosen(words: Column, at: Column) -> Column:
        reordered = F.concat(F.slice(words, F.greatest(at, F.lit(1)), F.lit(1)), F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(words, at + 1, F.size(words)))
        return F.when(at > 0, reordered).otherwise(F.concat(F.array(F.lit("operate")), words))

    return _once(F.transform(split_name(name), lambda w: F.lower(w)), feature)


def kebab(feature: Column) -> Column:
    return F.array_join(atomic_words(feature), "-")


def normalize_feature(s: Column) -> Column:
    return F.array_join(atomic_words(s), " ")


def atomic_words(s: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(s)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def dedupe_features(features: Column, limit: int = 0) -> Column:
    out = F.array_distinct(F.filter(F.transform(features, normalize_feature), lambda f: f != ""))
    return F.slice(out, 1, limit) if limit > 0 else out


def word_set(features: Column) -> Column:
    """Distinct words of all features."""
    return F.array_distinct(F.flatten(F.transform(features, atomic_words)))


def cluster_key(feature: Column) -> Column:
    """First word of a feature, or the second where the first is generic; misc for none."""

    def key(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        return F.when(F.size(parts) == 0, "misc").when((F.size(parts) >= 2) & first.isin(GENERIC_VERBS), F.get(parts, F.lit(1))).otherwise(first)

    return _once(F.filter(F.split(feature, r"[-_/ @]"), lambda w: w != ""), key)


def classify_symbol(feature: Column) -> Column:
    first = F.substring_index(F.substring_index(feature, "@", 1), "-", 1)
    return F.when(first == "", "general").otherwise(first)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def drift(old: Column, new: Column) -> Column:
    """Distance of two feature lists by words: both empty 0, one empty 1."""
    a, b = word_set(old), word_set(new)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(F.round(1 - jaccard(a, b), 3))


def topk_overlap(a: Column, b: Column, k: int) -> Column:
    """Jaccard of the first k distinct entries; both empty 1."""
    if k < 1:
        return F.lit(0.0)
    x, y = F.slice(F.array_distinct(a), 1, k), F.slice(F.array_distinct(b), 1, k)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))))


def is_exported(name: Column, language: Column) -> Column:
    return F.when(language == "go", F.rlike(name, F.lit(r"^\p{Lu}"))).when(language == "python", ~F.startswith(name, F.lit("_"))).otherwise(F.lit(True))


def snippet(source: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both included."""
    return F.array_join(F.slice(F.split(source, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def code_preview(source: Column, start: Column, end: Column, lines: int = 20) -> Column:
    first = F.array_join(F.slice(F.split(source, "\n"), 1, lines), "\n")
    return F.when(F.octet_length(source) > 1 << 20, F.lit("")).when(start > 0, snippet(source, start, normalize_end(start, end))).otherwise(first)


def normalize_end(start: Column, end: Column) -> Column:
    return F.when((end <= 0) | (end < start), start).otherwise(end)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    e1, e2 = normalize_end(s1, e1), normalize_end(s2, e2)
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def estimate_tokens(s: Column) -> Column:
    return F.floor((F.octet_length(s) + 3) / 4).cast("long")


def grep_tokens(results: Column) -> Column:
    """Tokens that a plain search would have cost: three times 512 for each result, 50 for none."""
    return F.when(results > 0, results * 512 * 3).otherwise(50).cast("long")


def summary_context(feature: Column, children: Column, limit: int = 20) -> Column:
    """A sentence on a node from its children's features, sorted by id before."""
    return F.concat(feature, F.lit(": "), F.array_join(F.slice(children, 1, limit), ", "))
