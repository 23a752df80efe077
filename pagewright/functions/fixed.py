"""Fixed values that results depend on: word lists, weights, limits and patterns. Nothing here is computed."""

# Endings that a Korean run of a query may lose, longest first where several fit.
QUERY_ENDINGS = (
    "했다던데 됐다던데 다던데 라던데 냐던데 했는데 됐는데 었는데 았는데 였는데 인가요 있나요 없나요 되나요 하나요 "
    "했나요 됐나요 였나요 었나요 할까요 일까요 습니까 합니까 됩니까 입니까 인데요 이에요 거예요 건가요 는가요 던가요 "
    "으려면 하려면 려면 "
    "했어 했고 했다 했지 했나 했던 했을 했니 됐어 됐고 됐다 됐지 됐나 됐던 었어 았어 였어 었고 았고 였고 었다 았다 "
    "였다 었지 았지 였지 었던 았던 였던 었니 났어 났다 났고 "
    "해야 해서 하면 하는 하지 하고 하게 하니 하나 할까 한다 한데 되는 되고 되면 되지 되나 된다 는데 던데 은데 어야 "
    "아야 어서 아서 니까 으니 더니 다고 냐고 라고 는지 은지 인지 던지 나요 가요 까요 지요 거야 건가 인가 는가 던가 "
    "뭐야 이야 이지 이죠 예요 에요 래요 대요 "
    "어 야 지 죠 니 냐 나 까 요"
).split()
# Particles, taken off after an ending.
QUERY_PARTICLES = (
    "에서는 에서도 에서의 으로는 으로도 으로서 으로써 에게서 에게는 까지는 까지도 부터는 이라고 이라는 이라면 이랑은 "
    "에서 으로 에게 한테 께서 까지 부터 처럼 보다 마다 이나 이랑 라고 라는 이고 이며 에는 에도 와는 과는 와의 과의 "
    "로는 로도 로서 로써 만큼 대로 밖에 조차 마저 "
    "은 는 이 가 을 를 에 의 와 과 도 로 만 랑"
).split()
# Question words whose bigrams carry no content.
STOP_WORDS = (
    "나요 가요 인가요 인가 무엇 무엇인가요 어떤 어느 언제 얼마 누구 현재 지금 하나요 되나요 있나요 까요 인지 는지 무슨 어떻게 얼마인가요 "
    "기준으로 따르면 몇 무엇을 어디 어디에 이며 이고"
).split()
# Stop words of the scan path.
SCAN_STOP_WORDS = (
    "그리고 그러면 하지만 그런데 그래서 관련 관련해서 대해 대해서 무엇 무엇인가 뭐야 뭔가 어떻게 어떤 어디 언제 왜 누가 "
    "알려줘 알려주세요 해줘 해주세요 정리해줘 설명해줘 설명 요약 요약해줘 가능한가 가능해 있나요 있어 있는지 인가요 인가 일까 "
    "정도 부분 내용 경우 때문 우리 지금 현재 다시 조금 많이 이거 그거 저거 이것 그것 저것 여기 거기 저기 하나 전부 "
    "모두 그냥 좀 안녕 안녕하세요 고마워 감사합니다 사항 관하여 "
    "the a an and or but if of to in on for with is are was were be been do does did can could should would will what how why "
    "when where who which this that these those it its you your me my we our please tell show explain about from into there "
    "here not no yes get set use using make need want"
).split()

# The search tokenizer.
RUN = "[0-9a-z_][0-9a-z_.\\-:/]*|[가-힣]+"
RUN_TAIL = "[.\\-:/]+$"
RUN_PARTS = "[_.\\-:/]+"
SCAN_TOKEN = "[0-9A-Za-z_][0-9A-Za-z_.\\-]*|[가-힣]+"

# Lexical score.
K1, B = 1.2, 0.75
MAX_POSTINGS, MAX_TERMS, MAX_DF_SHARE = 400, 24, 0.30
TAIL_WEIGHT, IDF_POWER, CANDIDATES = 0.25, 3.0, 200
ANCHOR_WEIGHT, CURRENT_WEIGHT, CONFLICT_WEIGHT = 1.35, 1.04, 0.97
CLAMP = 65_535
# Page re-ranking.
PAGE_B, TYPE_WEIGHT, HUB_WEIGHT, HUB_LABELS, HUB_BLOCKS = 0.25, 1.2, 0.5, 200, 300
COMPILED_TYPES = ("concept", "entity", "synthesis")
# Graph.
SEEDS, STEPS, FRONTIER, GRAPH_WEIGHT, STEP_DECAY, FANOUT = 30, 2, 50, 0.85, 0.5, 64
RELATED_WEIGHT, OTHER_WEIGHT = 1.0, 0.15
CURATED = ("related", "supersedes")
# Time, evidence, cut, synonyms.
STALE_SHOW, MAX_EVIDENCE, CUT, SYNONYM_WEIGHT, TOP = 0.30, 3, 0.5, 0.5, 10
NO_EVIDENCE_KINDS = ("heading", "thematic_break")
# Rendering budgets.
ROW_CHARS, ROW_LEAST, MAX_BYTES, MAX_TOKENS, MID_PAGES, WEAK_LINES = 320, 40, 6000, 2000, 2, 3
# Scan path.
FIELD_WEIGHTS = {"title": 8.0, "tags": 5.0, "projects": 4.0, "summary": 4.0, "body": 1.5}
KIND_BONUS = {"conflict": 2.5, "current": 1.5, "table": 0.5, "list": 0.25}
SCAN_SCORE, SCAN_COVERAGE, SCAN_MATCHED = 6.0, 0.34, 5
HINT_SCORE, HINT_COVERAGE, HINT_MATCHED, HINT_PAGES = 2.5, 0.30, 4, 3

# Page model.
SCHEMA_VERSION = "1.1"
PAGE_TYPES = ("source", "entity", "concept", "synthesis", "project", "home", "index", "log")
PAGE_DIRS = {"source": "sources", "entity": "entities", "concept": "concepts", "synthesis": "syntheses", "project": "projects", "home": "", "index": "", "log": ""}
BLOCK_KINDS = ("heading", "paragraph", "list", "table", "quote", "conflict", "current", "open_question", "code", "thematic_break", "markdown", "raw")
LINK_KINDS = ("wiki", "source", "supersedes", "related")
UNLINKED_TYPES = ("home", "index", "log")
CONFLICT_MARK, CURRENT_MARK, OPEN_MARK = "⚠️ 상충", "✅ 현행", "❓ 미결"
WIKILINK = "\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|([^\\]]+))?\\]\\]"
SOURCE_REF = "^(?:page|source|raw):\\S+$|^user:\\d{4}-\\d{2}-\\d{2}$"
DATE = "^\\d{4}-\\d{2}-\\d{2}$"
# Patterns of Markdown that decide what a line is, and of the head of a file.
LIST_ITEM = r"\s*(?:[-*+]|\d+\.) "
HEADING = r"(#{1,6})\s+(.+)"
THEMATIC_BREAK = r"\s*(?:-{3,}|\*{3,}|_{3,})\s*"
PARAGRAPH_END = r"#{1,6}\s|```|\||\s*>|\s*(?:[-*+] |\d+\. )"
OPEN_OWNER = r"(?mi)^[ \t]*(?:owner|담당)[ \t]*:[ \t]*(\S.*?)[ \t]*$"
OPEN_DUE = r"(?mi)^[ \t]*(?:due|기한)[ \t]*:[ \t]*(\d{4}-\d{2}-\d{2})[ \t]*$"
HEAD_KEY = r"([^\s:#][^:]*):[ \t]*(.*)"
HEAD_ITEM = r"[ \t]+-[ \t]*(.*)"
FLOW_ITEM = r"""[ \t]*(?:"([^"]*)"|'([^']*)'|([^,]*))[ \t]*(?:,|$)"""
BLOCK_SCALARS = (">", "|", ">-", "|-", ">+", "|+")
NULLS = ("null", "~", "")
# Layout.
LAYOUT_RADIUS, GOLDEN = 18.0, 0.6180339887498949
GROUP_COLOURS = ("#65e79c", "#ff8dca", "#ffa56d", "#56e1f2", "#91a7ff", "#c69cff")
RESERVED_GROUPS = ("multi", "ungrouped")

# The ranker by substrings, aliases and typed hops. Its words, what an ending may be, its weights and limits.
HOP_WORD = "[0-9A-Za-zㄱ-ㆎ가-힣_][0-9A-Za-zㄱ-ㆎ가-힣_.\\-:/]*"
HOP_PARTICLES = (
    "으로부터 에서는 에게서 이라고 라고는 에서도 까지도 으로는 이라는 에게는 부터 까지 에서 에게 으로 라고 이나 이란 이든 한테 보다 처럼 마다 조차 "
    "밖에 이다 한다 된다 이며 하며 하고 이고 은가 는가 인가 나요 니까 지만 면서 는데 은데 "
    "은 는 이 가 을 를 의 에 도 만 와 과 로 야 라 며 고 든 나"
).split()
HOP_LEAST_CHARS, HOP_TERMS, HOP_POSTINGS, HOP_DF_SHARE = 2, 12, 400, 0.30
HOP_RARE_SHARE, HOP_RARE_WEIGHT, HOP_CANDIDATES, HOP_TAIL = 0.002, 0.60, 200, 0.25
ALIAS_WEIGHTS = {"alias": 1.00, "title": 0.70, "tag": 0.25}
ALIAS_TAG_TYPES = ("concept", "entity")
ALIAS_FANOUT, ALIAS_WORDS, ALIAS_TERM_WEIGHT, ALIAS_TERMS, ALIAS_DF_SHARE = 12, 3, 0.90, 6, 0.02
CONCEPT_SELF, CONCEPT_HOP, CONCEPT_FANOUT = 0.20, 0.25, 40
RELATION_WEIGHT, RELATION_MOST, RELATION_SOURCES = 0.30, 0.60, 60
RELATED_HOP, RELATED_SOURCES, RELATED_LEAST = 0.85, 15, 0.50
OLD_GATE, OLD_DECAY, FORWARD_WEIGHT, FORWARD_MORE, CHAIN_STEPS = 0.30, 0.70, 1.00, 0.02, 16
HOP_ANCHOR, SOURCES_BONUS, REFS_BONUS, CURRENT_BONUS, OPEN_CONFLICT_BONUS = 0.35, 0.05, 0.03, 0.04, -0.03
HOP_EVIDENCE, RELATION_EVIDENCE = 3, 3
