"""String and token functions of entity linking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters a search-engine query must escape, and the tags of encoded texts
SEARCH_SPECIALS = r'([+\-&|!(){}\[\]^"~*?:/])'
START_TAG, END_TAG, TITLE_TAG = "[CLS]", "[SEP]", "[unused2]"
NO_CONTEXT = "EMPTYCTXT"


def words(text: str | Column) -> Column:
    """Words of the lower-cased text, split at white space; an empty array for null or blank."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_letters(own: Column, vocabulary: Column) -> Column:
    """One private-use character per word, by its place in the vocabulary, so string functions compare words."""
    return F.array_join(F.transform(own, lambda w: F.char(F.array_position(vocabulary, w).cast("long") + 31)), "")


def word_levenshtein(a: str | Column, b: str | Column) -> Column:
    """1 - word edit distance / words of the longer text, lower-cased; 1 if both are empty.

    Words become characters; `char` yields 256 of them, so texts with more than 90 distinct words
    together take the array form (an edit-distance row folded over the words).
    """
    x, y = words(a), words(b)
    vocabulary = F.array_distinct(F.concat(x, y))
    longer = F.greatest(F.size(x), F.size(y))
    short = F.levenshtein(word_letters(x, vocabulary), word_letters(y, vocabulary))
    distance = F.when(F.size(vocabulary) <= 90, short).otherwise(_edit_rows(x, y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - distance / longer)


def _edit_rows(x: Column, y: Column) -> Column:
    """Edit distance of two arrays: one row of the table per word of x, each cell from its left neighbour."""
    start = F.sequence(F.lit(0), F.size(y))

    def next_row(row: Column, w: Column) -> Column:
        cells = F.sequence(F.lit(1), F.size(row) - 1)

        def cell(done: Column, j: Column) -> Column:
            left = F.element_at(done, -1)
            up, diagonal = F.element_at(row, j + 1), F.element_at(row, j)
            cost = F.when(F.element_at(y, j) == w, 0).otherwise(1)
            return F.concat(done, F.array(F.least(left + 1, up + 1, diagonal + cost)))

        grown = F.aggregate(cells, F.array(F.element_at(row, 1) + 1), cell)
        return F.when(F.size(row) > 1, grown).otherwise(F.array(F.element_at(row, 1) + 1))

    return F.element_at(F.aggregate(x, start, next_row), -1)


def multiset_jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all words, counted with repeats; 1 if both are empty."""
    x, y = words(a), words(b)
    times = lambda ws, w: F.size(F.filter(ws, lambda v: v == w))
    both = F.array_distinct(F.concat(x, y))
    shared = F.aggregate(both, F.lit(0), lambda s, w: s + F.least(times(x, w), times(y, w)))
    every = F.aggregate(both, F.lit(0), lambda s, w: s + F.greatest(times(x, w), times(y, w)))
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def set_jaccard_distance(a: str | Column, b: str | Column) -> Column:
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)


def jaccard_levenshtein_distance(a: str | Column, b: str | Column) -> Column:
    """Mean of set Jaccard distance and normalised character edit distance of the lower-cased texts."""
    x, y = (F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for c in (a, b))
    longer = F.greatest(F.length(x), F.length(y))
    edit = F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(x, y) / longer)
    return (set_jaccard_distance(a, b) + edit) / 2


def mention_key(mention: str | Column) -> Column:
    """Key that is equal exactly for mentions at string distance 0: short ones keep their case.

    Below four characters the distance is case-sensitive and otherwise at least 3; longer mentions
    are compared in lower case. A tag keeps the two kinds apart. Null stays null.
    """
    m = F.col(mention) if isinstance(mention, str) else mention
    return F.when(F.length(m) < 4, F.concat(F.lit("s:"), m)).when(m.isNotNull(), F.concat(F.lit("l:"), F.lower(m)))


def search_escape(text: str | Column) -> Column:
    """Text for a search-engine query: OR and AND between white space or text ends in lower case, special
    characters escaped. A character that follows a backslash counts as escaped, and a backslash stays as it is."""
    text = F.col(text) if isinstance(text, str) else text
    for word in ("OR", "AND"):
        text = F.regexp_replace(text, rf"(?<!\S){word}(?!\S)", word.lower())
    return F.regexp_replace(text, r"(?<!\\)" + SEARCH_SPECIALS, r"\\$1")


def clean_context(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == NO_CONTEXT, F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def last_words(text: str | Column, n: int) -> Column:
    w = F.filter(F.split(clean_context(text), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ")


def first_words(text: str | Column, n: int) -> Column:
    w = F.filter(F.split(clean_context(text), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, 1, n), " ")


def sentence_context(previous: Column, current: Column, following: Column, kind: str) -> Column:
    """Chosen sentences around a mention, joined: prev, next, prev_next or current."""
    parts = {"prev": [previous, current], "next": [current, following], "prev_next": [previous, current, following], "current": [current]}[kind]
    return F.trim(F.concat_ws(" ", *parts))


def pad(tokens: Column, length: int, filler: str = "") -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), F.lit(length) - F.size(tokens))))


def mention_window(left: Column, mention: Column, right: Column, length: int) -> Column:
    """Tokens around a mention within `length` places, tags included, padded with empty tokens.

    Half of the rest goes to each side; what one side leaves unused, the other takes. `mention`
    already holds its own tags. A quota of zero keeps no token of that side.
    """
    m = F.size(mention)
    left_quota = F.greatest(F.lit(0), F.floor((F.lit(length) - m) / 2) - 1).cast("int")
    right_quota = F.greatest(F.lit(0), F.lit(length) - m - left_quota - 2).cast("int")
    l, r = F.size(left), F.size(right)
    left_take = F.when(l <= left_quota, l).when(r <= right_quota, F.least(l, left_quota + right_quota - r)).otherwise(left_quota)
    right_take = F.when(r <= right_quota, r).when(l <= left_quota, F.least(r, right_quota + left_quota - l)).otherwise(right_quota)
    head = F.when(left_take > 0, F.slice(left, l - left_take + 1, left_take)).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(F.array(F.lit(START_TAG)), head, mention, F.slice(right, F.lit(1), right_take), F.array(F.lit(END_TAG)))
    return pad(F.slice(tokens, 1, length), length)


def candidate_tokens(title: Column, description: Column, length: int) -> Column:
    """Title, tag, description, cut to the length and padded."""
    body = F.slice(F.concat(title, F.array(F.lit(TITLE_TAG)), description), 1, length - 2)
    return pad(F.concat(F.array(F.lit(START_TAG)), body, F.array(F.lit(END_TAG))), length)


def pair_tokens(context: Column, candidate: Column, length: int) -> Column:
    """Context followed by the candidate without its start tag, cut to the length."""
    return F.slice(F.concat(context, F.slice(candidate, F.lit(2), F.size(candidate))), 1, length)


def truncated_lengths(a: Column, b: Column, room: int) -> Column:
    """Lengths left of a pair when tokens are dropped from the longer side (the second on a tie) until both fit."""
    la, lb = F.size(a), F.size(b)
    over = F.greatest(F.lit(0), la + lb - room)
    gap = la - lb
    # the longer side gives up its surplus first, then both give in turn, the second side first
    from_a = F.when(gap > 0, F.least(over, gap)).otherwise(0)
    from_b = F.when(gap < 0, F.least(over, -gap)).otherwise(0)
    rest = over - from_a - from_b
    return F.struct((la - from_a - F.floor(rest / 2)).cast("int").alias("a"), (lb - from_b - F.ceil(rest / 2)).cast("int").alias("b"))


def softmax(scores: Column, mask: Column | None = None) -> Column:
    """Softmax of an array; masked places (0) count as -1000."""
    s = scores if mask is None else F.zip_with(scores, mask, lambda x, m: F.when(m > 0, x).otherwise(-1000.0))
    top = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """0-based place of the largest value, the first on a tie."""
    return F.array_position(scores, F.array_max(scores)) - 1


def quoted_aliases(aliases: str | Column) -> Column:
    """Aliases that hold a letter or digit, quoted and joined by spaces."""
    aliases = F.col(aliases) if isinstance(aliases, str) else aliases
    return F.array_join(F.transform(F.filter(aliases, lambda a: a.rlike(r"[\p{L}\p{N}]")), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " ")


def page_url(wikipedia_id: Column, language: str = "en") -> Column:
    return F.when(wikipedia_id > 0, F.concat(F.lit(f"https://{language}.wikipedia.org/wiki?curid="), wikipedia_id.cast("string"))).otherwise("")
