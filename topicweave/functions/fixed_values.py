"""Results depend on these exact texts and numbers."""

# Topic names; the position is the label code.
LABEL_NAMES = [
    "Công nghệ",
    "Du lịch",
    "Giáo dục",
    "Giải trí",
    "Khoa học",
    "Kinh doanh",
    "Pháp luật",
    "Sức khỏe",
    "Thế giới",
    "Thể thao",
    "Thời sự",
    "Xe",
    "Đời sống",
]

# Text for a label code beyond the list of names, followed by the code.
UNKNOWN_LABEL_PREFIX = "Lớp "

# Publisher by domain; the first domain contained in the link wins.
PUBLISHER_DOMAINS = [
    ("vnexpress.net", "VnExpress"),
    ("vietnamnet.vn", "Vietnamnet"),
    ("baomoi.com", "Bao Moi Online"),
    ("dantri.com.vn", "Dan Tri Online"),
    ("laodong.vn", "Lao Dong Online"),
    ("tuoitre.vn", "TuoiTre Online"),
]
OTHER_PUBLISHER = "Other"

# Marker between title and content in the text that gets embedded.
TEXT_SEPARATOR = " </s> "

# Cell texts that a CSV read treats as missing (the pandas defaults).
NA_LITERALS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Search space and settings of the tuning runs.
LOG10_C_BOUNDS = (-2.0, 4.0)
GRID_POINTS = 12
CALIBRATION_C = 1.76702
DEFAULT_SEED = 42
N_FOLDS = 5
LEVY_BETA = 1.5
ABANDON_PROBABILITY = 0.25
LEVY_SCALE = 0.01

# Vietnamese vowels; each row is one vowel without tone, then acute, grave, hook, tilde, dot below.
TONED_VOWELS = [
    "aáàảãạ",
    "ăắằẳẵặ",
    "âấầẩẫậ",
    "eéèẻẽẹ",
    "êếềểễệ",
    "iíìỉĩị",
    "oóòỏõọ",
    "ôốồổỗộ",
    "ơớờởỡợ",
    "uúùủũụ",
    "ưứừửữự",
    "yýỳỷỹỵ",
]

# Syllable parts of Vietnamese spelling.
ONSETS = [
    "b", "c", "ch", "d", "đ", "g", "gh", "gi", "h", "k", "kh", "l", "m", "n", "ng", "ngh", "nh", "p", "ph",
    "qu", "r", "s", "t", "th", "tr", "v", "x",
]
NUCLEI = [
    "ai", "ao", "au", "ay", "âu", "ây", "eo", "êu", "ia", "iê", "iêu", "iu", "oa", "oai", "oay", "oă", "oe",
    "oeo", "oi", "ôi", "ơi", "ua", "uâ", "uây", "uê", "ui", "uô", "uôi", "uơ", "uy", "uya", "uyê", "uyu",
    "ưa", "ưi", "ươ", "ươi", "ươu", "ưu", "yê", "yêu",
]
CODAS = ["c", "ch", "m", "n", "ng", "nh", "p", "t"]
