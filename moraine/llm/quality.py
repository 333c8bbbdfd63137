"""Per-document text statistics, and the rules that tell prose from lists, tables, boilerplate and junk."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# fixed values: frequent function words, without accents
COMMON = {
    "en": "the a an and or but so of to in on at by for from with without as is are was were be been has have had it its this that these "
    "those he she they we you his her their our not no than then when while where which who because although after before during under "
    "over into about more there will would can could",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber doch denn zu zur zum im am auf von vom mit ohne aus bei "
    "nach fur als ist sind war waren wird wurde hat haben hatte es er sie wir ihr sich nicht kein keine dass wenn weil wahrend obwohl "
    "unter uber vor dieser diese",
    "it": "il lo la i gli le un uno una e o ma del della dello dei delle degli di da dal dalla nel nella con su sul sulla per tra al alla "
    "che chi come sono era erano ha hanno aveva non si piu anche se perche mentre dopo prima senza sotto questo questa",
    "fr": "le la les l une des du d et ou mais donc car dans sur sous par pour avec sans au aux ce cette ces elle ils elles nous vous "
    "est sont etait ont avait ne pas plus que qui qu quand tandis comme apres avant son sa ses il en se",
}
ALL_COMMON = frozenset(w for words in COMMON.values() for w in words.split())
LETTERS_OF_COMMON = frozenset("".join(sorted(w)) for w in ALL_COMMON if len(w) >= 2)
LONGEST_COMMON = max(map(len, LETTERS_OF_COMMON))

WORD = regex.compile(r"\p{L}+")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
BULLET = regex.compile(r"^\s*(?:[-*+•‣◦–—]\s|\(?\d{1,3}[.)]\s|\(?[a-z][.)]\s)")
END_MARKS = (".", "!", "?", "…", ":", ";")
BROKEN_CASE = regex.compile(r"\p{Ll}\p{Lu}")
LINE_BREAK = regex.compile(r"\r\n|[\n\r\v\f\x85  ]")
PARAGRAPH_BREAK = regex.compile(r"\n\s*\n")
SENTENCE_END = regex.compile(r"[.!?…][\])'\"”’»]*(?=\s|$)")
BAR = regex.compile(r"\s*\|\s*|\s+[•·›→]\s+|\t+")
ARROW = regex.compile(r"\s+»\s+")
DASH = regex.compile(r"\s+[-–—/]\s+")
SEPARATORS = frozenset("|\t•·›→»-–—/")
VOWEL = regex.compile(r"[aeiouyœæøаеёиоуыэюяіїєαεηιουω]")
MANY_CONSONANTS = regex.compile(r"[bcdfghjklmnpqrstvwxz]{6}|[бвгджзйклмнпрстфхцчшщ]{6}")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
UNSPACED_END = regex.compile(r"[。！？!?.…]|(?<=\p{Thai})\s")
TABLE_MARK = regex.compile(r"[|\t{}<>\[\]=;]|\.{4,}|\s{3,}|(?:[^,\s]+,){3}")

#: at least this share of common words makes a passage read as sentences
COMMON_SHARE = 0.12
#: from this many words on, a line is judged by itself, else with its neighbours
ENOUGH_WORDS = 12
#: a text is prose if at least this share of its visible characters stands in passages of sentences
PROSE_SHARE = 0.5
#: a text whose repeats cover more than this is junk whatever it says
REPEAT_SHARE = 0.6
#: a text is boilerplate if more than this share of it is lines or paragraphs that it has said before
DUPLICATE_SHARE = 0.5
#: repeated 10-grams count against a text that has fewer sentence ends than one in so many words
LONG_SENTENCE = 40
#: cells between separators, and bulleted items, of at most so many words and without a sentence end are no sentences
CELL_WORDS, ITEM_WORDS = 4, 7
#: dashes and slashes also part clauses and lines of verse, so their cells have to be shorter
DASH_WORDS = 2
#: words that a text in an unknown language needs to be judged by its build
SHAPE_WORDS = 12
#: texts described at once
BATCH_TEXTS = 1_000

STATS = [
    ("n_chars", "long"), ("n_words", "long"), ("n_lines", "long"), ("mean_word_length", "double"), ("symbol_ratio", "double"),
    ("digit_ratio", "double"), ("upper_ratio", "double"), ("end_mark_share", "double"), ("bullet_share", "double"), ("common_share", "double"),
    ("scrambled_share", "double"), ("duplicate_line_share", "double"), ("duplicate_paragraph_share", "double"),
    ("top_ngram_coverage", "double"), ("repeated_ngram_coverage", "double"), ("prose_share", "double"), ("is_prose", "boolean"), ("kind", "string"),
]


def _plain(text: str) -> str:
    """Lower case without accents and invisible characters, so that noise on letters hides no word."""
    return INVISIBLE.sub("", unicodedata.normalize("NFD", text)).lower()


def _duplicate_share(parts: list[str]) -> float:
    """Share of the characters that stand in repeats of an earlier part."""
    total = sum(map(len, parts))
    seen: set[str] = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over stretches, 0 for empty ones."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _ngram_coverage(ids: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Character shares per document of its most covering 2- to 4-gram, and of the words inside a 10-gram seen before.

    ids, size (letters) and doc of the words of a batch, in order. A document of fewer than eight words
    has neither. Grams are numbered from the shorter ones; only places whose 4-gram occurs again in
    their document can begin a repeated 10-gram.
    """
    total = np.bincount(doc, size, docs)
    enough = np.bincount(doc, minlength=docs) >= 8
    top, again = np.zeros(docs), np.zeros(docs)
    reach = np.concatenate([[0], np.cumsum(size)])
    gram, twice = ids, np.zeros(0, np.int64)
    for n in (2, 3, 4):
        m = len(ids) - n + 1
        if m <= 0:
            break
        key = gram[:m].astype(np.int64) * (int(ids.max()) + 1) + ids[n - 1 :]
        gram = np.unique(key, return_inverse=True)[1]
        inside = np.flatnonzero((doc[:m] == doc[n - 1 :]) & enough[doc[:m]])
        if not len(inside):
            continue
        named = doc[inside].astype(np.int64) * (int(gram.max()) + 1) + gram[inside]
        _, first, back, count = np.unique(named, return_index=True, return_inverse=True, return_counts=True)
        at = inside[first]
        np.maximum.at(top, doc[at], np.where(count > 1, count * (reach[at + n] - reach[at]), 0))
        twice = inside[count[back] > 1]
    twice = twice[twice + 10 <= len(ids)]
    twice = twice[doc[twice] == doc[twice + 9]]
    if len(twice):
        rows = np.column_stack([doc[twice], *(ids[twice + i] for i in range(10))])
        order = np.lexsort((twice, *rows.T[::-1]))
        same = np.concatenate([[False], (rows[order][1:] == rows[order][:-1]).all(1)])
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, twice[order][same], 1)
        np.add.at(cover, twice[order][same] + 10, -1)
        again = np.bincount(doc, np.where(np.cumsum(cover)[:-1] > 0, size, 0), docs)
    whole = np.maximum(total, 1)
    return np.minimum(1.0, top / whole), again / whole


def _separated(line: str) -> bool:
    """Whether most of a line is short cells between separators, as in menus, paths of pages and rows of tables."""
    if SEPARATORS.isdisjoint(line):
        return False
    for mark, least, most in ((BAR, 2, CELL_WORDS), (ARROW, 2, CELL_WORDS), (DASH, 3, DASH_WORDS)):
        if mark is ARROW and "«" in line:  # quotation marks
            continue
        cells = mark.split(line)
        if len(cells) <= least:
            continue
        short = sum(len(c) for c in cells if len(WORD.findall(c)) <= most and not (SENTENCE_END.search(c) and " " in c.strip()))
        if short > sum(map(len, cells)) / 2:
            return True
    return False


def _ends(line: str) -> bool:
    """Whether a line ends in a mark, closing quotes and brackets aside."""
    return line.rstrip().rstrip("'\"”’»)]")[-1:] in END_MARKS


def _sentence_shape(text: str, words: list[str], odd: float, visible: int) -> bool:
    """Whether a text has the build of running sentences in a language whose common words are not known here.

    Mostly letters, with sentence ends at the distances of sentences. Scripts without spaces: enough
    different characters. Others: at least SHAPE_WORDS words, most of them in small letters, of the
    lengths of words, short ones among them, with vowels and consonants in nearly all, few of them
    said again and again, and few that are rearranged common words or break case.
    """
    letters = sum(map(len, words))
    if letters < 0.75 * visible:
        return False
    unspaced = UNSPACED.findall(text)
    if len(unspaced) > letters / 2:
        ends = len(UNSPACED_END.findall(text))
        return len(unspaced) >= 20 and 0 < ends and len(unspaced) / ends <= 120 and len(set(unspaced)) >= min(60, 0.3 * len(unspaced))
    ends, n = len(SENTENCE_END.findall(text)), len(words)
    if n < SHAPE_WORDS or odd > 0.15 or not 4 <= n / max(1, ends) <= 45:
        return False
    raw = WORD.findall(text)
    small = sum(w[0].islower() for w in raw)
    short = sum(len(w) <= 3 for w in words)
    long = [w for w in words if len(w) >= 4]
    mixed = sum(VOWEL.search(w) is not None and not MANY_CONSONANTS.search(w) for w in long)
    return small >= 0.6 * len(raw) and 0.12 * n <= short <= 0.6 * n and 3 <= letters / n <= 9 and mixed >= 0.9 * len(long) and len(set(words)) >= 0.4 * n


def describe(text: str | None) -> tuple:
    return describe_all([text])[0]


def describe_all(texts: list[str | None]) -> list[tuple]:
    """The values of STATS for each text; for a null or blank text zeros, is_prose null and kind 'empty'.

    Words, lines and characters of the whole batch lie in flat arrays; what depends on a word or a
    character alone is looked up once for each different one.
    """
    held = [i for i, t in enumerate(texts) if t is not None and t.strip()]
    out: list[tuple] = [(len(t or ""), 0, 0, *[0.0] * 13, None, "empty") for t in texts]
    if not held:
        return out
    docs = len(held)
    raw_lines: list[str] = []
    plain_lines: list[str] = []
    n_lines, dup_lines, dup_paragraphs = np.zeros(docs, np.int64), np.zeros(docs), np.zeros(docs)
    for d, i in enumerate(held):
        text = texts[i]
        pairs = [(x, p) for x, p in zip(LINE_BREAK.split(text), LINE_BREAK.split(_plain(text)), strict=True) if x.strip()]
        n_lines[d] = len(pairs)
        raw_lines += [x for x, _ in pairs]
        plain_lines += [p for _, p in pairs]
        if len(pairs) > 1:
            dup_lines[d] = _duplicate_share([" ".join(p.split()) for _, p in pairs])
            paragraphs = PARAGRAPH_BREAK.split(text)
            if len(paragraphs) > 1:
                dup_paragraphs[d] = _duplicate_share([" ".join(p.split()) for p in paragraphs if p.strip()])
    lines_at = _starts(n_lines)
    doc_of = np.repeat(np.arange(docs), n_lines)
    size = np.array([len("".join(x.split())) for x in raw_lines])
    words_of = [WORD.findall(p) for p in plain_lines]
    per_line = np.array([len(w) for w in words_of])
    words = [w for ws in words_of for w in ws]
    words_at = _starts(per_line)
    ids, kinds = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
    length = np.array([len(w) for w in kinds], np.int64)
    common = np.array([w in ALL_COMMON for w in kinds], bool)
    odd = np.array([not c and len(w) <= LONGEST_COMMON and "".join(sorted(w)) in LETTERS_OF_COMMON for w, c in zip(kinds, common, strict=True)], bool)
    word_doc = np.repeat(doc_of, per_line)
    letters_of = length[ids] if len(ids) else np.zeros(0, np.int64)
    line_sum = lambda values: _sums(values[ids] if len(ids) else np.zeros(0, np.int64), words_at)
    good, bad, single, own = line_sum(common), line_sum(odd), line_sum(length == 1), line_sum(length)
    broken = np.array([len(BROKEN_CASE.findall(x)) for x in raw_lines])
    bullets = np.array([BULLET.match(x) is not None for x in raw_lines], bool)
    ended = np.array([_ends(x) for x in raw_lines], bool)
    cells = np.array([_separated(x) for x in raw_lines], bool)
    # invisible characters and accents would cut a word in two, so the plain line is asked
    item = bullets & (per_line <= ITEM_WORDS)
    item[np.flatnonzero(item)] = [not _ends(plain_lines[k]) for k in np.flatnonzero(item)]
    before = np.concatenate([[False], doc_of[1:] == doc_of[:-1]])
    after = np.concatenate([before[1:], [False]])
    listed = item & ((before & np.roll(item, 1)) | (after & np.roll(item, -1)))

    by_doc = lambda values: _sums(values, lines_at)
    all_common, all_odd = by_doc(good), by_doc(bad) + by_doc(broken)
    open_ = ~(cells | listed)  # the others are no passages of sentences, nor parts of their neighbours'
    count, g, b, k, one = (np.where(open_, x, 0) for x in (per_line, good, bad, broken, single))
    own_count, own_good = count, g
    alone = (count >= ENOUGH_WORDS) | (n_lines[doc_of] == 1)
    near = lambda x: x + np.where(before, np.roll(x, 1), 0) + np.where(after, np.roll(x, -1), 0)
    count, g, b, k, one = (np.where(alone, x, near(x)) for x in (count, g, b, k, one))
    n = np.maximum(count, 1)
    passage = (own_count > 0) & (own / np.maximum(1, size) >= 0.55) & (one <= n / 2) & ((g - 1.5 * b - k) / n >= COMMON_SHARE) & ~((own_count >= 6) & (own_good == 0))
    prose, visible = by_doc(np.where(passage, size, 0)), by_doc(size)
    top, repeated = _ngram_coverage(ids, letters_of, word_doc, docs)
    n_words, letters = np.bincount(word_doc, minlength=docs), np.bincount(word_doc, letters_of, docs).astype(np.int64)

    points = np.frombuffer("".join(texts[i] for i in held).encode("utf-32-le", "surrogatepass"), "<u4")
    chars_at = _starts(np.array([len(texts[i]) for i in held]))
    marks, place = np.unique(points, return_inverse=True)
    digits = _sums(np.array([chr(c).isdigit() for c in marks])[place], chars_at)
    upper = _sums(np.array([chr(c).isupper() for c in marks])[place], chars_at)
    end_share, bullet_share = by_doc(ended) / n_lines, by_doc(bullets) / n_lines
    share = prose / np.maximum(1, visible)

    for d, i in enumerate(held):
        text, s = texts[i], slice(lines_at[d], lines_at[d + 1])
        again = dup_lines[d] > DUPLICATE_SHARE or dup_paragraphs[d] > DUPLICATE_SHARE
        if not again and repeated[d] > REPEAT_SHARE:
            again = len(SENTENCE_END.findall(text)) * LONG_SENTENCE < n_words[d]
        shaped, odd_share = share[d] >= PROSE_SHARE, all_odd[d] / max(1, n_words[d])
        known = all_common[d] >= COMMON_SHARE * n_words[d]  # then the language is one of those, and the passages decide
        if not shaped and not known and not again and top[d] <= REPEAT_SHARE and size[s][open_[s]].sum() >= PROSE_SHARE * visible[d]:
            shaped = _sentence_shape(text, [w for ws in words_of[s] for w in ws], odd_share, int(visible[d]))
        is_prose = bool(shaped and top[d] <= REPEAT_SHARE and not again)
        if is_prose:
            kind = "prose"
        else:
            # a row of a table begins with its mark or holds numbers
            menus = sum(z for x, z, c in zip(raw_lines[s], size[s], cells[s], strict=True) if c and x.strip()[0] != "|" and sum(map(str.isdigit, x)) < 0.1 * z)
            if menus > visible[d] / 2 or again and shaped:
                kind = "boilerplate"
            elif bullet_share[d] > 0.5:
                kind = "list"
            elif sum(bool(TABLE_MARK.search(x)) for x in raw_lines[s]) > n_lines[d] / 2:
                kind = "table"
            else:
                kind = "junk"
        v, w = max(1, int(visible[d])), int(n_words[d])
        out[i] = (
            len(text), w, int(n_lines[d]), float(letters[d]) / w if w else 0.0, max(0.0, 1 - (int(letters[d]) + int(digits[d])) / v), int(digits[d]) / v,
            int(upper[d]) / max(1, int(letters[d])), float(end_share[d]), float(bullet_share[d]), int(all_common[d]) / max(1, w), float(odd_share),
            float(dup_lines[d]), float(dup_paragraphs[d]), float(top[d]), float(repeated[d]), float(share[d]), is_prose, kind,
        )
    return out


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Statistics of every row: key and the columns of STATS; other columns are ignored.

    A row is judged by itself over its whole text, without a shuffle. is_prose is false when more
    than half of the visible characters stand outside passages of sentences, when one short word
    group covers most of the words, when more than half of the text is lines or paragraphs said
    before, or when repeated 10-grams cover most of a text that hardly has sentence ends. Lines of
    short cells between separators and rows of short bulleted items without sentence ends are no
    passages. Else passages are lines, short ones judged with their neighbours, so
    wrapped prose holds together; the share of common words, less broken case and rearranged common
    words, decides, in capitals or small letters, with or without marks and accents. A text whose
    share of known words is below COMMON_SHARE is still prose if it has the build of running sentences
    (`_sentence_shape`), in any script; that needs SHAPE_WORDS words. A text under eight words has no n-gram shares.
    """
    kind = dict(df.dtypes)[key]
    names = [n for n, _ in STATS]
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                some = batch.slice(at, BATCH_TEXTS)
                columns = zip(*describe_all(some.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *[pa.array(c, arrow[t]) for c, (_, t) in zip(columns, STATS, strict=True)]], [key, *names]
                )

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in STATS))
