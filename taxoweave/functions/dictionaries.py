"""Word lists and lookup tables."""

from __future__ import annotations

# Stop words of plain keywords.
KEYWORD_STOP = ("и", "или", "для", "в", "на", "с", "по", "от", "к", "из")

# Stop words of meaningful words, in Russian, Ukrainian and English.
MEANINGFUL_STOP = (
    "для", "в", "на", "с", "по", "от", "к", "из", "за", "под", "над",
    "та", "або", "з", "від", "до", "із", "під",
    "the", "and", "or", "for", "in", "on", "with", "by", "from", "to", "of", "at",
)

# Advanced keywords leave out these two as well.
ADVANCED_STOP = ("и", "или", *MEANINGFUL_STOP)

# Suffixes in the order in which they are tried.
SUFFIXES = ("ний", "тий", "ов", "ев", "ий", "ый", "ой", "ая", "ое", "ые", "ні", "на", "не")

# Letters that are written differently in Ukrainian, and what stands for them.
TRANSLIT_FROM, TRANSLIT_TO = "їієґ", "ииег"

# Synonyms for the smart scores.
SYNONYMS = {
    "глушители": ["глушник", "глушники", "глушитель", "exhaust", "muffler"],
    "глушники": ["глушитель", "глушители", "exhaust", "muffler"],
    "глушник": ["глушители", "глушители", "exhaust", "muffler"],
    "масло": ["масла", "oil", "олія", "олія", "lubricant"],
    "масла": ["масло", "oil", "олія", "lubricant"],
    "моторное": ["моторний", "моторна", "моторні", "engine", "motor"],
    "моторні": ["моторное", "моторный", "engine", "motor"],
    "моторний": ["моторное", "моторная", "engine", "motor"],
    "распродажа": ["розпродаж", "sale", "clearance", "скидка", "discount"],
    "розпродаж": ["распродажа", "sale", "clearance", "скидка", "discount"],
    "скидка": ["розпродаж", "распродажа", "sale", "discount"],
    "скидкой": ["розпродаж", "распродажа", "sale", "discount"],
    "товары": ["товар", "продукция", "товари", "products", "goods"],
    "товари": ["товары", "товар", "продукция", "products", "goods"],
    "товары со скидкой": ["розпродаж", "распродажа", "sale"],
    "товары на распродаже": ["розпродаж", "sale"],
    "шлем": ["шолом", "шоломи", "helmet", "casque"],
    "шлемы": ["шоломи", "шолом", "helmets"],
    "шоломи": ["шлемы", "шлем", "helmets"],
    "шолом": ["шлем", "шлемы", "helmet"],
    "мотоциклетный": ["мотоциклетна", "мотоциклетні", "motorcycle", "байкерский"],
    "мотоциклетна": ["мотоциклетный", "мотоциклетные", "motorcycle"],
    "мотоциклетні": ["мотоциклетные", "мотоциклетный", "motorcycle"],
    "байкерский": ["мотоциклетный", "мотоциклетні", "biker"],
    "фильтр": ["фільтр", "filter"],
    "фільтр": ["фильтр", "фильтры", "filter"],
    "фильтры": ["фільтри", "фільтр", "filters"],
    "фільтри": ["фильтры", "фильтр", "filters"],
    "воздушный": ["повітряний", "air"],
    "повітряний": ["воздушный", "воздушные", "air"],
    "шины": ["шини", "покрышки", "tires", "tyres"],
    "шини": ["шины", "покрышки", "tires", "tyres"],
    "покрышки": ["шины", "шини", "tires", "tyres"],
    "диски": ["диск", "wheels", "rims"],
    "литые": ["литий", "alloy", "cast"],
    "автомобильный": ["автомобільний", "авто", "car", "auto"],
    "автомобільний": ["автомобильный", "авто", "car", "auto"],
    "автомобильные": ["автомобільні", "авто", "car", "auto"],
    "автомобільні": ["автомобильные", "авто", "car", "auto"],
    "зимний": ["зимові", "зимняя", "winter"],
    "зимові": ["зимний", "зимние", "winter"],
    "зимние": ["зимові", "зимний", "winter"],
    "летний": ["літні", "літня", "summer"],
    "літні": ["летние", "летний", "summer"],
    "летние": ["літні", "летний", "summer"],
    "инструменты": ["інструменти", "tools"],
    "інструменти": ["инструменты", "инструмент", "tools"],
    "химия": ["хімія", "chemistry", "chemicals"],
    "хімія": ["химия", "chemistry", "chemicals"],
    "автохимия": ["автохімія", "car chemicals"],
    "автохімія": ["автохимия", "car chemicals"],
    "навигатор": ["навігатор", "navigator", "gps"],
    "навігатор": ["навигатор", "navigator", "gps"],
    "мультимедиа": ["мультімедіа", "multimedia"],
    "мультімедіа": ["мультимедиа", "multimedia"],
    "свечи": ["свічки", "spark plugs", "plugs"],
    "свічки": ["свечи", "spark plugs", "plugs"],
    "зажигание": ["запалювання", "ignition"],
    "запалювання": ["зажигание", "ignition"],
    "колодки": ["колодочки", "brake pads", "pads"],
    "тормозные": ["гальмівні", "brake"],
    "гальмівні": ["тормозные", "brake"],
}

# The short list of synonyms that automatic matches use.
BASIC_SYNONYMS = {
    "глушители": ["глушники", "exhaust"],
    "масло": ["масла", "oil"],
    "моторное": ["моторні", "motor"],
    "скидки": ["розпродаж", "sale", "discount"],
    "товары": ["товари", "products"],
    "автомобильные": ["автомобільні", "automotive", "auto"],
    "запчасти": ["запчастини", "parts"],
    "аксессуары": ["аксесуари", "accessories"],
}

# Words that hint at a branch, and their families.
BRANCH_HINTS = {
    "автомобильный": ["авто", "машин", "транспорт"],
    "мотоциклетный": ["мото", "байк", "motorcycle"],
    "зимний": ["зима", "холод", "снег"],
    "летний": ["лето", "жара", "солнце"],
    "детский": ["дети", "ребенок", "малыш"],
    "женский": ["женщин", "дама", "леди"],
    "мужской": ["мужчин", "парен", "мужик"],
}

#: For catalogues of parts in English: the same kinds of table, as parameters of our queries.
PART_SYNONYMS = {
    "economy": ["small", "cold"],
    "small": ["mini", "new"],
    "medium": ["gear", "plate"],
    "promo": ["red", "hot"],
    "standard": ["old", "bolt"],
    "large": ["big", "anvil"],
    "red": ["promo", "large"],
}
PART_HINTS = {"large": ["anvil", "plate"], "small": ["ring", "rod"], "red": ["hot"]}

# Words that say nothing about a category of goods.
GOODS_STOP = ("все", "товары")
