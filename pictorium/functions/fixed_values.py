"""Fixed values.

Word lists, lookup tables, limits and patterns that decide results.  They are
kept together here, as plain text, because results are only right with
exactly these values.
"""

# --- fixed values: search -------------------------------------------------
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "与", "把", "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "to", "for", "of",
    "with", "by", "from", "as", "into", "and", "or", "but", "not", "no", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "that", "this", "these", "those", "it", "its", "what", "which", "who", "whom",
]

# --- fixed values: ingest -------------------------------------------------
MAX_FILE_BYTES = 50 * 1024 * 1024
EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "ico", "tiff", "tif", "avif"]
MIME_BY_EXTENSION = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "tiff": "image/tiff",
    "tif": "image/tiff",
    "avif": "image/avif",
}
MIME_TYPES = [
    "image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/x-icon", "image/tiff", "image/avif",
    "image/heic", "image/heif",
]
# header bytes as hex: extension -> alternatives, each a list of (byte offset, hex)
MAGIC = {
    "jpg": [[(0, "FFD8FF")]],
    "jpeg": [[(0, "FFD8FF")]],
    "png": [[(0, "89504E470D0A1A0A")]],
    "gif": [[(0, "474946")]],
    "webp": [[(0, "52494646"), (8, "57454250")]],
    "bmp": [[(0, "424D")]],
    "ico": [[(0, "00000100")]],
    "tiff": [[(0, "49492A00")], [(0, "4D4D002A")]],
    "tif": [[(0, "49492A00")], [(0, "4D4D002A")]],
    "avif": [[(4, "6674797061766966")]],
}
MAX_PATH_BYTES = 240
ENCODED_TRAVERSAL = [
    "%2e%2e",
    "%252e%252e",
    "%c0%ae",
    "..%2f",
    "..%5c",
    "%u002e%u002e",
    "&#46;&#46;",
    "..",
]
SYSTEM_DIRECTORIES = ["/usr/bin", "/usr/sbin", "/bin", "/sbin", "/etc"]

# --- fixed values: categories and consistency rules -----------------------
# canonical name -> (aliases, display name)
CATEGORIES = {
    "landscape": (["风景", "landscape"], "风景"),
    "person": (["人物", "person"], "人物"),
    "object": (["物品", "object"], "物品"),
    "animal": (["动物", "animal"], "动物"),
    "architecture": (["建筑", "architecture", "building"], "建筑"),
    "document": (["文档", "document"], "文档"),
    "other": ([], "其他"),
}
EXPECTED_TAG_WORDS = {
    "landscape": ["山", "水", "自然", "风景", "天空", "树", "海", "日落", "日出"],
    "person": ["人", "脸", "笑容", "群体", "儿童", "老人"],
    "object": ["物品", "产品", "静物", "桌子", "椅子", "工具"],
    "animal": ["狗", "猫", "鸟", "鱼", "马", "动物", "宠物"],
    "architecture": ["建筑", "楼房", "桥梁", "塔", "室内", "城市"],
    "document": ["文字", "截图", "文档", "表格", "扫描"],
}
GENERIC_TAGS = ["彩色", "黑白", "清晰", "模糊", "高清", "夜景", "白天", "室内", "室外"]
DESCRIPTION_WORDS = {
    "landscape": ["风景", "自然", "山", "水", "天空", "树木", "草地", "湖"],
    "person": ["人", "脸", "笑容", "肖像", "人物", "自拍"],
    "object": ["物品", "产品", "静物", "物体", "工具"],
    "animal": ["动物", "狗", "猫", "鸟", "鱼", "宠物", "野生"],
    "architecture": ["建筑", "楼房", "桥梁", "塔", "大厦", "教堂"],
    "document": ["文字", "文档", "截图", "扫描", "表格", "书"],
}
OPPOSITE_WORDS = {
    "landscape": ["人", "建筑", "动物", "文档"],
    "person": ["风景", "动物", "建筑", "文档"],
    "object": ["风景", "人物", "动物", "建筑", "文档"],
    "animal": ["风景", "人物", "建筑", "文档"],
    "architecture": ["风景", "人物", "动物", "文档"],
    "document": ["风景", "人物", "动物", "建筑"],
}
# first family whose marker occurs in the tag decides
TAG_FAMILIES = [
    ("狗", ["狗", "宠物", "毛"]),
    ("猫", ["猫", "宠物", "胡须"]),
    ("山", ["山", "峰", "登山", "山顶"]),
    ("海", ["海", "水", "波浪", "沙滩"]),
    ("建筑", ["建筑", "楼房", "大厦"]),
    ("人", ["人", "脸", "笑容"]),
    ("文", ["文字", "文档", "截图"]),
]
CONFLICT_TAGS_TEXT = "分类({category}) 与标签不一致: {tags}"
CONFLICT_DESCRIPTION_TEXT = "分类({category}) 与描述内容矛盾。描述中包含 {words} 相关关键词"
CONFLICT_SUPPORT_TEXT = "标签({tag}) 在描述中未找到支持内容"
VERIFIED_FROM = 0.85
PROVISIONAL_FROM = 0.50
CORRECT_FROM = 0.7
MAX_ATTEMPTS = 3

# --- fixed values: narrative entities -------------------------------------
PERSON_PREFIXES = ["和", "与", "跟"]
PLACE_PREFIXES = ["在", "去", "到", "从"]
PLACE_SUFFIXES = ["的", "那", "玩", "出差", "旅行", "旅游", "逛", "吃饭", "拍照", "看", "住", "走"]
TIME_WORDS = ["去年", "今年", "昨天", "今天", "上个月", "这个月", "前年"]
WEEK_PREFIXES = ["周", "星期"]
WEEK_DAYS = ["一", "二", "三", "四", "五", "六", "日", "天"]
# body of a regex character class: the CJK ideograph blocks
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)

# --- fixed values: redaction patterns -------------------------------------
SECRET_PREFIX = (
    r"Bearer\s+|sk[-_]|api_key\s*[:=]\s*|token\s*[:=]\s*|authorization\s*[:=]\s*"
    r"|password\s*[:=]\s*|secret\s*[:=]\s*"
)
SECRET_CHARS = r"[A-Za-z0-9_-]"
ENCRYPTED_PREFIX = r"enc:v[12]:"
ENCRYPTED_CHARS = r"[A-Za-z0-9+/=]"
# flags i = ignore case, U = Unicode classes, d = only \\n ends a line
WINDOWS_PATH = r"(?iU)[A-Za-z]:\\(?:[^\s:\\/]+[\\/])*[^\s:\\/]*\.\w+"
UNIX_PATH = r"(?iU)/(?:home|Users|tmp|var|opt|etc|srv)/(?:[^\s/]+)/[^\s]*"
URL_SECRET = (
    r"(?iU)([?&](?:token|api_key|apikey|access_token|secret|password|auth|credential))"
    r"=[^&\s\x22\x27]*"
)
ERROR_PATH = r"(?iU)(?:[A-Za-z]:\\|/)(?:[^\s:\\/]+[\\/])+[^\s:\\/]*"
ERROR_SQL = r"(?id)\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|PRAGMA)\b.+?(?:;|\z)"

# --- fixed values: graph --------------------------------------------------
NODE_TYPES = ["image", "entity", "tag", "concept"]
EDGE_TYPES = ["semantic", "tag_overlap", "temporal", "location", "face_match", "custom"]
SEMANTIC_FROM = 0.7

# --- fixed values: near duplicates ----------------------------------------
FINGERPRINT_BITS = 64
DEFAULT_DISTANCE = 10

# fixed values: MIME types of pictures sent to a model, by extension
MODEL_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
