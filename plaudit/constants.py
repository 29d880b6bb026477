"""Fixed values that must equal the reviewed application's for equal results.

Everything in this module is data, stated plainly and in its natural order.
Order matters where noted: several look-ups take the *first* entry whose key
is contained in the input text.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: rating text -> base score (first contained key wins, in order)
# ---------------------------------------------------------------------------
RATING_BASE_SCORE = [
    ("Overwhelmingly Positive", 98),
    ("好评如潮", 98),
    ("Very Positive", 88),
    ("特别好评", 88),
    ("Mostly Positive", 85),
    ("多半好评", 85),
    ("Positive", 82),
    ("好评", 82),
    ("Mixed", 60),
    ("褒贬不一", 60),
    ("Mostly Negative", 30),
    ("多半差评", 30),
    ("Negative", 10),
    ("差评", 10),
    ("Overwhelmingly Negative", 5),
    ("差评如潮", 5),
    ("No user reviews", 50),
    ("无评分", 50),
]
DEFAULT_BASE_SCORE = 50

# FIXED VALUES: rating text -> display text (first contained key wins, in order)
RATING_DISPLAY = [
    ("Overwhelmingly Positive", "好评如潮"),
    ("Very Positive", "特别好评"),
    ("Mostly Positive", "多半好评"),
    ("Positive", "好评"),
    ("Mixed", "褒贬不一"),
    ("Mostly Negative", "多半差评"),
    ("Negative", "差评"),
    ("Overwhelmingly Negative", "差评如潮"),
    ("No user reviews", "无评分"),
]
NO_RATING = "无评分"

# FIXED VALUES: critical-flaw keywords (case-sensitive substrings)
CRITICAL_FLAW_KEYWORDS = ["闪退", "崩溃", "bug", "服务器", "连接", "优化", "掉帧", "欺诈", "打不开", "无法启动"]

# FIXED VALUES: suggestion texts
SUGGEST_ABOVE_90 = "【必玩神作】(90-100分) 官方评级极高，且我们的分析未发现明显短板。"
SUGGEST_ABOVE_75 = "【强烈推荐】(75-90分) 游戏总体优秀。官方评级高，核心体验良好。"
SUGGEST_ABOVE_50 = "【褒贬不一】(50-75分) 游戏评价两极分化。官方评级尚可，但请注意减分项。"
SUGGEST_OTHER = "【不推荐】(25-50分) 踩雷风险较高。官方评级低，且存在明显短板。"
SUGGEST_BELOW_25 = "【千万别买】(0-25分) 风险极高！"
NOTE_OPT = " [注意：游戏“优化/联机”问题被普遍提及]"
NOTE_VALUE = " [注意：玩家普遍认为游戏“性价比”偏低]"
NOTE_REFUND = " [注意：大量差评集中在2小时内（可能存在Bug或欺诈）]"
NOTE_FLAW = " [注意：主题中检测到“闪退/崩溃”等硬伤关键词]"
SUGGEST_NO_REVIEWS = "评论数据不足，评估中立。"
NEUTRAL_SCORE = 50

# FIXED VALUES: penalty weights and thresholds
OPT_PENALTY_WEIGHT = 15.0
VALUE_PENALTY_WEIGHT = 10.0
REFUND_PENALTY_WEIGHT = 10.0
REFUND_MAX_MINUTES = 120
NOTE_MAX_SCORE = 75
NOTE_OPT_ABOVE = 10.0
NOTE_VALUE_ABOVE = 7.0
NOTE_REFUND_ABOVE = 7.0

# FIXED VALUES: prices that count as free (after removing the currency sign and commas)
FREE_PRICE_WORDS = ["free", "免费", "0"]
FREE_PRICE = "免费"

# FIXED VALUES: aspect score columns, radar names, hypothesis sentences (same order)
SCORE_COLUMNS = ["score_gameplay", "score_visuals", "score_story", "score_opt", "score_value"]
RADAR_NAMES = ["玩法性", "画面/音乐", "剧情叙事", "优化/联机", "性价比"]
ASPECT_HYPOTHESES = ["玩法很有趣", "画面很精美", "剧情很感人", "运行很流畅", "价格很良心"]
RADAR_MAX = 100
NEUTRAL_ASPECT = 0.5

# FIXED VALUES: play-time stages, right-closed minute bins (lower, upper] and labels
PLAYTIME_BINS = [-1, 120, 600, 1200, 999999]
PLAYTIME_LABELS = ["0-2h (初见)", "2-10h (中期)", "10-20h (深入)", "20h+ (老手)"]
STAGE_FILL = 0.5

# FIXED VALUES: ingest defaults
ANONYMOUS_AUTHOR = "匿名"
UNKNOWN = "未知"
NO_DESCRIPTION = "暂无简介"
PROFILE_NO_NAME = "匿名用户"
PROFILE_UNKNOWN = "未知用户"
DEFAULT_AVATAR = "/static/default_avatar.png"
ARTEFACT_READ_FAILED = "分析缓存读取失败。"

# FIXED VALUES: cache rules
CACHE_HOURS = 6
ARTEFACT_KINDS = ["score", "pos_topics", "neg_topics", "radar", "playtime_sentiment", "timeseries"]
SAMPLE_PER_POLARITY = 50
MAX_PAGES = 10

# FIXED VALUES: topic text rules
TOPIC_KEYWORDS_N = 7
TOPIC_WORDS_N = 20
TOPIC_DOCS_N = 3
SUMMARY_CUT = 60
KEYWORD_SEP = "、"
SUMMARY_SEP = " | "
NO_SUMMARY = "暂无代表性评论。"
NO_TOPIC_TOOLTIP = "(无关联主题)"
MIN_TOPIC_SIZE = 5
SCORING_MAX_CHARS = 512
CARD_MAX_CHARS = 100

# FIXED VALUES: domain stopwords added to the stopword file (120 distinct words)
DOMAIN_STOPWORDS = [
    "游戏", "这个", "真的", "没有", "一个", "就是", "什么", "不是", "但是", "可以", "感觉", "不能", "不会", "会",
    "steam", "epic", "uplay", "dev", "player", "players", "devs",
    "哈哈", "哈哈哈", "哈哈哈哈", "嘎嘎", "咕咕", "xswl", "666", "yyds",
    "个人", "觉得", "玩", "比较", "问题", "建议", "希望", "知道", "小时",
    "方面", "总体", "来说", "目前", "东西", "内容", "体验", "有点", "很多", "一些",
    "怎么", "那么", "所以", "如果", "还是", "因为", "而且", "还有", "以及", "一堆",
    "反正", "为什么", "一块", "这款", "u003d",
    "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m",
    "n", "o", "p", "q", "r", "s", "t", "u", "v", "w", "x", "y", "z",
    "an", "is", "it", "to", "the", "and", "of", "in", "on", "for", "with",
    "my", "you", "me", "he", "she", "we", "they", "get", "go", "so",
    "lol", "wtf", "omg", "gg", "nice", "good", "bad", "play", "game", "games",
]

# FIXED VALUES: text-cleaning patterns (Java regex and RE2 alike). Python's
# Unicode whitespace (str.isspace) is spelled out, since \s is ASCII-only in
# Java and RE2 (and differs between them on \x0B).
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
PAT_URL = r"http[^" + WS + r"]+"
PAT_TAG = r"<[^>]+>"
PAT_MENTION = r"@[\p{L}\p{N}_]+"
PAT_HASHTAG = r"#[\p{L}\p{N}_]+"
PAT_STRIP = r"^[" + WS + r"]+|[" + WS + r"]+$"
PAT_SPLIT = r"[" + WS + r"]+"
PAT_TOPIC_KEEP = r"[^\x{4e00}-\x{9fa5}a-zA-Z]"
PAT_LAZY_TAG = r"<[^\n]*?>"
PAT_CTRL_WS = r"[\n\r\t]"
PAT_DISPLAY_KEEP = r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9" + WS + r".,!?]"
HAN = r"\x{4e00}-\x{9fa5}"
