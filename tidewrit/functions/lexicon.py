"""Closed vocabularies of spoken Vietnamese numbers, letters, units and types."""

# --- types, in their frozen order -------------------------------------------------------------------------------
NUMERIC = ["CARDINAL", "ORDINAL", "DIGIT_SEQ", "DECIMAL", "FRACTION", "PERCENT", "RANGE", "RATIO", "MONEY", "MEASURE", "VERSION"]
DATETIME = ["DATE", "TIME", "TIMEZONE", "DURATION", "ETA", "ETD", "QUARTER"]
MARITIME = ["COORD", "HEADING", "BEARING", "SPEED", "DISTANCE", "DEPTH", "DRAFT", "FREQUENCY", "CHANNEL"]
IDENTIFIER = ["MMSI_ID", "IMO_ID", "TELEPHONE", "CALLSIGN", "VESSEL_ID", "PORT_CODE", "DOCUMENT_ID", "LEGAL_DOC_ID", "ELECTRONIC", "VEHICLE_PLATE", "ADDRESS"]
ENTITY = ["EQUIPMENT_ID", "EQUIPMENT_NAME", "FOREIGN_NAME", "ACRONYM", "MARITIME_TERM", "PERSON_NAME", "LOCATION_NAME", "RANK"]
TYPES = NUMERIC + DATETIME + MARITIME + IDENTIFIER + ENTITY
CRITICAL = ["COORD", "HEADING", "BEARING", "MMSI_ID", "IMO_ID", "TELEPHONE", "CALLSIGN", "PORT_CODE", "FREQUENCY"]
CATALOGUED = ["EQUIPMENT_NAME", "FOREIGN_NAME", "ACRONYM", "MARITIME_TERM"]
STRICT_IDENTIFIERS = ["MMSI_ID", "IMO_ID", "TELEPHONE", "CALLSIGN", "VESSEL_ID", "PORT_CODE", "DOCUMENT_ID", "LEGAL_DOC_ID", "VEHICLE_PLATE"]
DEFAULT_THRESHOLD, CRITICAL_THRESHOLD, CATALOGUE_THRESHOLD = 0.60, 0.90, 0.75
SIBLINGS = {"MMSI_ID": ["TELEPHONE", "IMO_ID"], "TELEPHONE": ["MMSI_ID", "IMO_ID"], "IMO_ID": ["MMSI_ID", "TELEPHONE"]}
PUNCTUATION = {"COMMA": ",", "PERIOD": ".", "QUESTION": "?"}

# --- numbers ----------------------------------------------------------------------------------------------------
DIGITS = {"không": 0, "linh": 0, "một": 1, "mốt": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "nhăm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9}
SHORT_UNITS = {"mốt": 1, "lăm": 5, "nhăm": 5, "tư": 4}
SCALES = {"nghìn": 10**3, "ngàn": 10**3, "triệu": 10**6, "tỷ": 10**9, "tỉ": 10**9}
FILLERS = {"lẻ", "linh"}
NEGATIVE = {"âm", "trừ"}
STRUCTURE = {"mười", "mươi", "trăm", *SCALES}
COMMA_WORDS, DOT_WORDS = {"phẩy", "phảy"}, {"chấm"}
NUMBER_WORDS = {*DIGITS, *FILLERS, *STRUCTURE}
#: Words of a number signature, tried in this order.
SIGNATURE_WORDS = ["mười", "mươi", "trăm", "nghìn", "không", "một", "mốt", "hai", "ba", "bốn", "tư", "năm", "lăm", "nhăm", "sáu", "bảy", "bẩy", "tám", "chín", "linh", "lẻ", "triệu", "tỷ", "tỉ", "ngàn"]

# --- letters ----------------------------------------------------------------------------------------------------
LETTERS = {
    "A": ["a", "ây"], "B": ["bê", "bi"], "C": ["xê", "cê", "xi"], "D": ["dê", "đi"], "Đ": [], "E": ["e"], "F": ["ép", "e phờ"], "G": ["giê", "gờ"],
    "H": ["hát", "âych"], "I": ["i"], "J": ["gi"], "K": ["ka", "ca", "kây"], "L": ["e lờ", "lờ", "eo"], "M": ["em", "mờ", "e mờ"],
    "N": ["en", "nờ", "e nờ", "en nờ"], "O": ["ô", "o"], "P": ["pê", "pờ", "pi"], "Q": ["quy", "kiu"], "R": ["rờ", "e rờ"], "S": ["ét", "sờ"],
    "T": ["tê", "ti"], "U": ["u", "diu"], "V": ["vê", "vi"], "W": ["vê kép"], "X": ["ích"], "Y": ["y", "i dài", "i cờ rét"], "Z": ["dét"],
}
#: The name that stands for D in codes and for Đ in acronyms.
D_OR_DD = "đê"
DASHES = ["dấu gạch ngang", "dấu gạch nối", "dấu gạch", "gạch ngang", "gạch nối", "gạch", "-"]
SLASHES = ["gạch chéo", "xẹt", "xẹc", "trên", "phần", "/"]

# --- units ------------------------------------------------------------------------------------------------------
UNITS = {
    "mm": ["mi li mét", "mi li met", "mi limet"], "cm": ["xăng ti mét", "xen ti mét"], "dm": ["đề xi mét"], "m": ["mét", "met"],
    "km": ["ki lô mét", "ki lo mét", "ki lo met"], "mg": ["mi li gam"], "g": ["gam"], "kg": ["ki lô gam", "ký"], "t": ["tấn"], "ml": ["mi li lít"],
    "l": ["lít"], "m²": ["mét vuông"], "km²": ["ki lô mét vuông"], "m³": ["mét khối"], "ha": ["héc ta"], "A": ["am pe"], "V": ["vôn", "von"],
    "W": ["oát"], "kW": ["ki lô oát"], "MW": ["mê ga oát"], "bar": ["bar"], "hPa": ["héc tô pát xcan", "héc tô pascal"], "dB": ["đề xi ben", "đê xi ben"],
    "Hz": ["héc", "hẹc"], "kHz": ["ki lô héc"], "MHz": ["mê ga héc", "mê ga hẹc"], "GHz": ["gi ga héc"], "°C": ["độ xê", "độ c", "độ xen ti gờ rát"],
    "°": ["độ"], "NM": ["hải lý", "hải_lý"], "kn": ["nút"], "fm": ["sải"], "%": ["phần trăm"],
}
PER_LEADS = ["một", "trên", "mỗi", ""]
PER_UNITS = {"giờ": "h", "giây": "s", "phút": "min"}
UNIT_SETS = {"SPEED": ["kn", "km/h", "m/s", "m/h"], "DISTANCE": ["NM", "km", "m", "cm", "mm", "dm", "fm"], "DEPTH": ["m", "cm", "fm"], "DRAFT": ["m", "cm"], "FREQUENCY": ["Hz", "kHz", "MHz", "GHz"]}
KNOTS = {"NM/h": "kn", "NM": "kn"}
CURRENCIES = {"đồng": ["đồng"], "VND": ["vnd", "việt nam đồng"], "USD": ["đô", "đô la", "đô la mỹ", "usd"], "EUR": ["euro", "ơ rô"], "JPY": ["yên"], "GBP": ["bảng"], "CNY": ["nhân dân tệ", "tệ"]}
CHANNELS = {"kênh": "Kênh", "channel": "Channel", "ch": "Ch."}

# --- date and time ----------------------------------------------------------------------------------------------
DAY_WORDS = {"ngày", "mùng", "mồng"}
ZONE_SIGNS = {"cộng": "+", "dương": "+", "trừ": "-", "âm": "-"}
ZONES = {"LT": ["giờ địa phương", "địa phương", "thời gian địa phương", "giờ theo địa phương"], "UTC": ["giờ phối hợp quốc tế", "phối hợp quốc tế", "thời gian phối hợp quốc tế", "giờ quốc tế", "thời gian quốc tế", "u tê xê", "u ti xi"]}
ETA_ETD = {"ETA": (["ê tê a", "e tê a", "i ti ây", "eta"], ["dự", "kiến", "đến"]), "ETD": (["ê tê đê", "e tê đê", "i ti đi", "etd"], ["dự", "kiến", "rời"])}
DURATION_UNITS = ["giờ", "phút", "giây", "ngày", "tuần", "tháng", "năm"]
ROMAN = ["I", "II", "III", "IV"]

# --- position ---------------------------------------------------------------------------------------------------
DIRECTIONS = {"bắc": "N", "nam": "S", "đông": "E", "tây": "W", "n": "N", "s": "S", "e": "E", "w": "W"}
AXIS_WORDS = {"vĩ", "kinh", "vĩ_độ", "kinh_độ"}
BEARING_WORDS = {"hướng", "phương", "vị", "phương_vị", "độ"}

# --- identifiers ------------------------------------------------------------------------------------------------
ID_PREFIXES = {"MMSI_ID": ["em em ét i", "mờ mờ ét i", "mmsi"], "IMO_ID": ["i em ô", "ai em ô", "imo"], "TELEPHONE": ["số điện thoại", "điện thoại", "số"]}
CALL_WORDS = {"hô", "hiệu", "hô_hiệu", "callsign"}
ELECTRONIC_SYMBOLS = {
    "www": ["vê kép vê kép vê kép", "kép kép kép", "ba vê kép"], "https": ["hát tê tê pê ét"], "http": ["hát tê tê pê"], "_": ["gạch dưới", "gạch chân"],
    "-": ["gạch ngang", "gạch nối", "gạch"], ":": ["hai chấm"], "/": ["gạch chéo", "sờ lát", "xẹt"], "@": ["a còng", "a móc", "át", "còng"], ".": ["chấm", "dot"],
}
PROTOCOL_LEADS = ["giao thức", "chuẩn", "địa chỉ"]
PROTOCOL_STEMS = ["i p v", "i p vê", "i p phiên bản", "ai pi vi", "ip vờ"]
BLOCKS = {"lô": "Lô", "block": "Block", "khu": "Khu"}
PLACE_WORDS = {"đường", "phố", "ngõ", "hẻm", "quận", "huyện", "phường", "xã", "tỉnh", "thôn", "ấp", "lộ"}
OTHER_ADDRESS_WORDS = {"số", "khu", "tổ", "đại"}
VERSION_WORDS = {"phiên", "bản", "phiên_bản", "version"}
VERSION_MARKS = {"vê": "v", "vi": "v", "v": "v", "version": "Version"}
ENGLISH_RANKS = {"captain", "chief", "officer", "second", "third", "master", "mate", "engineer", "bosun", "pilot", "admiral", "rear", "vice", "commander", "lieutenant", "colonel", "major", "general", "sergeant", "cadet", "deck", "able", "seaman", "ordinary", "electrician", "cook", "oiler"}
