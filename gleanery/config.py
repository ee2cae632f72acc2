"""Thresholds and vocabularies of the curation jobs, in one place; operators take them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of the rules that the jobs carry over: every default below is one."""

    # usefulness score
    gate_points: int = 70
    ceremony_weight: int = 2
    firsthand_weight: int = 3
    specific_weight: int = 2
    day_weight: int = 2
    promotional_penalty: int = 4
    promotional_from: int = 7
    no_criteria_score: int = 20
    # evidence
    min_text_length: int = 30
    max_link_density: float = 0.70
    min_paragraphs: int = 1
    excerpt_chars: int = 600
    slice_chars: int = 1500
    # publication
    publish_cap: int = 150
    drift_similarity: float = 0.70
    rationale_min: int = 38
    rationale_max: int = 210
    anchor_min: int = 6
    label_level: int = 6
    # retries
    retry_hours: tuple[int, ...] = (1, 6, 24)
    retry_ttl_hours: int = 72
    due_limit: int = 50
    stale_hours: int = 72
    # hosts
    requests_per_day: int = 200
    spacing_seconds: int = 20
    strike_hours: int = 24
    retry_after_seconds: int = 60
    lastmod_alert: int = 100
    restore_tolerance: float = 0.2
    yield_days: int = 7
    yield_ratio: float = 0.5
    freshness_days: int = 10
    # feed
    page: int = 24
    page_max: int = 240
    run_budget: int = 40
    grading_batch: int = 30
    topic_batch: int = 25


CONFIG = Config()

# Query parameters that only track visitors, as a pattern over a parameter's name.
TRACKING = r"(?i)^(utm_.*|fbclid)$"

# Named entities, in the order in which they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))

# The blanks of Unicode's space separators, line ends and the byte order mark.
BLANKS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Extended_Pictographic of Unicode 16 (emoji-data), as intervals of code points in hexadecimal.
PICTOGRAPHS = """
    A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE
    2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767
    2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299
    1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F
    1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF
    1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD
"""

# Label sentences of the rationale, in order, by criterion.
LABELS = (
    ("firsthand", "実際に挙式・披露宴を経験した立場からの記述である"),
    ("ceremonyDecision", "挙式・披露宴の中身の意思決定に役立つ内容を含む"),
    ("specific", "具体的な選択や工夫についての記述がある"),
    ("weddingDayContent", "フルパッケージ結婚式当日の内容（進行・演出など）に具体的に触れている"),
)

# Prefixes with which an honorific names no person.
SAFE_PREFIXES = ("みな", "皆", "おふたり", "お二人", "ふたり", "二人", "新郎新婦", "新郎", "新婦", "花嫁", "花婿", "ゲスト", "お客", "参列者", "スタッフ", "プランナー")

# Topics that are too general to keep.
GENERIC_TOPICS = (
    "準備の進め方", "心構え", "確認ポイント", "ポイント", "注意点", "基本事項", "基礎知識", "演出", "準備", "演出の工夫", "前撮り",
    "家族婚", "美容", "DIY", "神前式", "会場選び", "挙式演出", "ご祝儀", "式場見学", "撮影準備", "見積もり",
)

# Terms of access and of prohibition; a change is restrictive if one sentence has both.
ACCESS_TERMS = r"(?i)クロール|クローリング|スクレイピング|スクレイプ|自動(?:で|的に)?(?:収集|取得|アクセス)|ロボット|robot|crawl|scrape|複製|転載"
PROHIBIT_TERMS = r"禁止|禁じ|許可なく|許諾なく|同意なく|お断り|不可"

CRITERIA = ("firsthand", "ceremonyDecision", "specific", "weddingDayContent", "promotional")

# Outcomes of a discovery run that skip a URL for good, and those that leave it as it was.
SKIPPED_OUTCOMES = ("path", "robots", "404", "410", "too_large", "no_title", "exhausted")
KEPT_OUTCOMES = ("kill_gate", "budget", "retry_after")

# Patterns of error messages, in the order in which they are tried.
ERROR_PATTERNS = (
    ("rate_capped", r"(?i)429|rate[-_\s]?limit|too many requests|quota|exhausted"),
    ("transient", r"(?i)5\d\d|overloaded|unavailable|timeout|gateway|econnreset|etimedout|enotfound"),
    ("terminal", r"(?i)auth|api[-_\s]?key|permission|unauthorized|forbidden|invalid[-_\s]?argument|bad[-_\s]?request|not[-_\s]?found"),
)

# Fixed value: a name with an honorific after it.
HONORIFIC = r"([\p{L}\p{N}ー]{1,10})(?:さん|様|氏|くん|君|ちゃん)"
