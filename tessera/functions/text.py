"""Text features as Catalyst expressions: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+"
#: What a text needs to have any CJK run, number or date.
MORE = CJK.removesuffix("]+") + r"\p{Nd}]"
WORD = "[a-z0-9]+"
NUMBER = r"(?U)\d+(?:[.,]\d+)*"
DATE = r"(?U)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?"
PHRASE = r'[\x{201c}"]([^\x{201d}"]{1,64})[\x{201d}"]'
ENTITY = r"(?U)\b(?:[A-Z][a-zA-Z0-9]{1,}|[A-Z]{2,})\b"

# Vocabularies that recall and intents depend on.
STOP = "a an and answer are as at be been best by did do does for from he her his how i in is it matches memory of on or question she that the their they this to was we were what when where which who with you 了 什么 和 在 是 有 的".split()
TEMPORAL = ("现在 目前 当前 如今 最近 最新 眼下 这个月 这周 今天 近期 改成 换成 还是 已经".split(), ["now", "current", "currently", "latest", "recent", "recently", "today", "these days", "nowadays", "at present", "up to date", "still"])
UPDATE = (
    "更新为 改为 改成 换为 换成 调整为 变更为 转为 已上调 已下调 上调为 下调为 最新口径 新口径 作废 不再 取代 替换为 迁移到 搬到".split(),
    ["updated to", "changed to", "switched to", "revised to", "is now", "no longer", "replaced by", "supersedes", "deprecated", "new value", "effective from", "moved to", "migrated to"],
)
PREFERENCE = ("喜欢 偏好 首选 最爱 爱用 常用 习惯 更愿意 合我".split(), ["prefer", "preference", "favorite", "favourite", "go-to", "usually use", "tend to use", "like to use"])
RECOMMEND = ("推荐 建议 适合我 适合我们 为我挑 帮我选".split(), ["recommend", "suggest", "for me", "suit me", "matches my", "complement my"])
NUMERIC = ("多少 几个 几号 几点 金额 预算 价格 费用 数量 编号 号码 版本 余额 额度 比例 百分比".split(), ["how much", "how many", "amount", "budget", "price", "cost", "number", "version", "balance", "quota", "percentage", "ratio"])
CALENDAR = ("什么时候 何时 哪天 哪一天 日期 几号 年月日".split(), ["when", "what date", "which date", "release date", "start date", "end date"])
DIRECT_PREFERENCE = [
    "(?:我|本人|我们)[^。！？!?]{0,16}(?:喜欢|偏好|首选|最爱|爱用|常用|习惯|更愿意)",
    r"(?i)\b(?:i|we)\s+(?:(?:really|usually|generally)\s+)?(?:prefer|like|favor|favour|use|tend\s+to\s+use)\b",
    r"(?i)\b(?:my|our)\s+(?:favorite|favourite|preferred|go-to)\b",
]
DIRECT_PROFILE = ["我|本人", r"(?i)\b(?:i|i'm|i’ve|i've|i’d|i'd|my|mine|we|we're|we’ve|we've|our|ours)\b"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    return F.lower(text(c))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def cjk_ngrams(c: Column, n: int) -> Column:
    """The n-grams within each run of CJK characters."""
    runs = F.filter(_all(text(c), CJK), lambda r: F.length(r) >= n)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))))


def words(c: Column) -> Column:
    return _all(normalize(c), WORD)


def _plain(numbers: Column) -> Column:
    return F.transform(numbers, lambda x: F.replace(x, F.lit(","), F.lit("")))


def numbers(c: Column) -> Column:
    return _plain(_all(text(c), NUMBER))


def dates(c: Column) -> Column:
    return _all(text(c), DATE)


def non_date_numbers(c: Column) -> Column:
    return numbers(F.regexp_replace(text(c), DATE, " "))


def phrases(c: Column) -> Column:
    return _all(text(c), PHRASE, 1)


def _entity_candidates(c: Column) -> Column:
    names = _all(text(c), ENTITY)
    return F.when(text(c).rlike(CJK), F.concat(names, cjk_ngrams(c, 2), cjk_ngrams(c, 3), cjk_ngrams(c, 4))).otherwise(names)


def entities(c: Column) -> Column:
    """Capitalised Latin words and CJK 2- to 4-grams, the first of those that differ in case only."""
    every = _entity_candidates(c)
    low = F.transform(every, F.lower)
    return F.transform(F.array_distinct(low), lambda x: F.element_at(every, F.array_position(low, x).cast("int")))


def entities_lower(c: Column) -> Column:
    return F.array_distinct(F.transform(_entity_candidates(c), F.lower))


def protection_entities(c: Column) -> Column:
    return F.filter(entities(c), lambda x: ~F.lower(x).isin(STOP))


def tokenize(c: Column, max_ngram: int = 3) -> Column:
    low = normalize(c)
    other = F.concat(_all(low, WORD), numbers(low), dates(low))
    every = F.when(low.rlike(CJK), F.concat(*[cjk_ngrams(low, n) for n in range(1, max(1, max_ngram) + 1)], other)).otherwise(other)
    return F.when(low.rlike(MORE), every).otherwise(_all(low, WORD))


def index_tokens(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def index_text(c: Column) -> Column:
    return F.array_join(index_tokens(c), " ")


def query_tokens(c: Column, cap: int = 64) -> Column:
    """Distinct tokens without stop words, longest first, then in code-point order, at most cap."""
    kept = F.filter(index_tokens(c), lambda t: ~t.isin(STOP) & (t != ""))
    order = F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(order, lambda s: s["t"]), 1, max(1, cap))


def pieces(token: Column) -> Column:
    """The index terms of a token: what stands between its separators."""
    cut = F.filter(F.split(token, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.when(token.rlike(r"[^\p{L}\p{N}]"), cut).when(token != "", F.array(token)).otherwise(F.array().cast("array<string>"))


def index_terms(c: Column) -> Column:
    """The terms of the indexed text in order: dates and decimals contribute their pieces once more. Words alone are pieces as they are."""
    return F.when(normalize(c).rlike(MORE), F.flatten(F.transform(index_tokens(c), pieces))).otherwise(F.array_distinct(words(c)))


def _any(c: Column, marks: tuple[list[str], list[str]]) -> Column:
    """Chinese marks in the text, English ones in the lower-cased text, anywhere."""
    pattern = lambda xs: "|".join(re.escape(x).replace("\\ ", " ").replace("\\-", "-") for x in xs)
    return text(c).rlike(pattern(marks[0])) | normalize(c).rlike(pattern(marks[1]))


def temporal_intent(c: Column) -> Column:
    return _any(c, TEMPORAL)


def update_cue(c: Column) -> Column:
    return _any(c, UPDATE)


def preference_intent(c: Column) -> Column:
    return _any(c, PREFERENCE)


def personalization_intent(c: Column) -> Column:
    return _any(c, PREFERENCE) | _any(c, RECOMMEND)


def numeric_intent(c: Column) -> Column:
    return _any(c, NUMERIC)


def date_intent(c: Column) -> Column:
    return _any(c, CALENDAR)


def direct_preference(c: Column) -> Column:
    return text(c).rlike("|".join(f"(?:{p})" for p in DIRECT_PREFERENCE))


def direct_profile(c: Column) -> Column:
    return direct_preference(c) | text(c).rlike("|".join(f"(?:{p})" for p in DIRECT_PROFILE))


def signature(c: Column) -> Column:
    """Distinct tokens of two characters or more."""
    return F.filter(index_tokens(c), lambda t: F.length(t) >= 2)


def once(value: Column, use) -> Column:
    """use(value), with the value computed once a row: within a lambda its expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hits(values: Column, low: Column) -> Column:
    """How many of the values are substrings of the lower-cased text."""
    return once(low, lambda t: F.size(F.filter(values, lambda v: F.contains(t, v))))


# -- the single-table baseline's tokens


def baseline_tokens(c: Column) -> Column:
    """CJK single characters and pairs, and words of letters and digits; a pair spans Latin letters that stand between its characters without a separator."""
    low = normalize(c)
    spans = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda s: s != "")
    cjk = F.filter(F.transform(spans, lambda s: F.regexp_replace(s, CJK.replace("[", "[^").removesuffix("+"), "")), lambda s: s != "")
    single = F.flatten(F.transform(cjk, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))))
    pairs = F.flatten(F.transform(F.filter(cjk, lambda s: F.length(s) >= 2), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))))
    latin = F.filter(F.flatten(F.transform(spans, lambda s: F.split(s, CJK))), lambda s: s != "")
    return F.concat(single, pairs, latin)


def baseline_score(content: Column, query: Column, tokens: Column) -> Column:
    low, q = normalize(content), normalize(query)
    return F.when((q != "") & F.contains(low, q), 1000).otherwise(0) + hits(F.array_distinct(tokens), low) * 10
