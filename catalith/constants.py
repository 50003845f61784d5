"""Thresholds, dictionaries and patterns of the catalogue rules."""

from __future__ import annotations

# Price outliers.
UPPER_RATIO, LOWER_RATIO, MIN_DELTA, RELATIVE_DELTA = 2.6, 0.38, 50_000, 0.35
PAIR_RATIO, PAIR_MIN_DELTA = 4, 150_000
INSTALMENT_CUTOFF = 100_000

# Search and ranking.
COVERAGE = 0.7
SCORE_WORD, SCORE_ALL, SCORE_PHRASE, SCORE_CATEGORY, SCORE_BUNDLE, SCORE_PRICE, PRICE_STEP = 25, 120, 120, 30, -120, 20, 200_000
READ_LIMIT, READ_LIMIT_MAX, PAGE_SIZE = 240, 1200, 12

# Home sections.
FEATURED_LIMIT, DROP_LIMIT, FRESH_HOURS, WINDOW_HOURS = 8, 8, 24, 24
DROP_PERCENT, DROP_AMOUNT, GUARD_SECONDS = 0.05, 10_000, 1

# Retention, change capture, staleness.
RAW_DAYS, HOURLY_DAYS, DAILY_DAYS = 14, 90, 365
HEARTBEAT_HOURS, STALE_MINUTES, HOT_PRICES = 12, 20, 3
#: Products that a refresh request looks at, at least.
LEAST_LOOKED_AT = 50

# Telemetry and alerts.
SLOW_MS, BLOCKED_ALERT, ERROR_ALERT, EMPTY_ALERT, SUCCESS_ALERT, P95_ALERT_MS, MIN_REQUESTS = 8000, 3, 3, 5, 80, 12_000, 5
LOG_ROWS = 160

# Rate limits, caches, sitemap.
SEARCH_LIMIT, SEARCH_WINDOW_SECONDS, FRESH_SHARE = 30, 60, 0.8
SITEMAP_PAGE = 2000

DEFAULT_IMAGE = "/pixel-box.svg"
CATEGORIES = (
    "procesadores tarjetas-graficas motherboards memoria-ram almacenamiento fuentes-alimentacion gabinetes refrigeracion perifericos"
).split()
COMPONENT_CATEGORIES = ("procesadores", "tarjetas-graficas", "memoria-ram")
SEARCH_TERMS = {
    "procesadores": "procesador", "tarjetas-graficas": "placa de video", "motherboards": "motherboard", "memoria-ram": "memoria ram",
    "almacenamiento": "ssd", "fuentes-alimentacion": "fuente", "gabinetes": "gabinete", "refrigeracion": "cooler", "perifericos": "perifericos",
}

# Titles.
BUNDLE_TERMS = ("combo", "kit", "armado", "pc gamer", "build")
COMPONENT_BUNDLE_TERMS = (
    "pc gamer", "combo", "armado", "pc completa", "computadora", "desktop", "workstation", "notebook", "laptop",
    "all in one", "netbook", "chromebook", "kit ", "bundle", "paquete",
)
DEDUPE_STOPWORDS = "de del la el los las y con para por vga placa video procesador micro cpu gpu gamer".split()
STRICT_VARIANTS = (
    "aorus strix tuf dual prime proart eagle windforce gaming ventus shadow suprim trinity phoenix pulse nitro "
    "challenger hellhound tomahawk mortar ds3h hero lightspeed"
).split()
SINGLE_VARIANTS = ("x", "g", "f", "k")
BRANDS = (
    "asus|gigabyte|msi|zotac|palit|inno3d|asrock|pny|xfx|sapphire|intel|amd|logitech|razer|hyperx|corsair|steelseries|redragon|"
    r"keychron|cooler\s*master|benq|aoc|viewsonic|samsung|lg|dell|hp|lenovo"
)
GPU_CHIP = r"rtx\s*\d{3,4}(?:\s*(?:ti|super))?|gtx\s*\d{3,4}(?:\s*(?:ti|super))?|rx\s*\d{3,4}(?:\s*xt)?|arc\s*[a-z]?\s*\d{3}"
GPU_VARIANTS = (
    "aorus,strix,tuf,dual,prime,proart,eagle,windforce,gaming,ventus,shadow,suprim,trinity,phoenix,pulse,nitro,challenger,"
    "hellhound,red devil,white"
).split(",")
MB_VARIANTS = "aorus,strix,tuf,prime,tomahawk,mortar,steel legend,ds3h,pro,elite,gaming,eagle".split(",")
MODEL_STOPWORDS = (
    "teclado keyboard mouse monitor auricular auriculares headset microfono microphone webcam camara cam gamer gaming rgb usb "
    "bluetooth mecanico mecanica mechanical switch con sin de del la el los las para por edition series"
).split()
NOISY_SUFFIXES = "usb rgb wireless bluetooth espanol ingles spanish english black white negro blanco gris gray".split()
VARIANT_HINTS = "x hero lightspeed wireless pro plus max mini se v2 v3 mk2 mk3".split()
MERGED_VARIANT = r"^([a-z]+\d{2,5})(x|pro|plus|max|mini|hero|v2|v3)$"
FAMILIES = (
    ("kbd", r"\b(teclado|keyboard|keycaps?)\b"),
    ("mouse", r"\b(mouse|mice|raton)\b"),
    ("monitor", r"\b(monitor|display|panel|ips|va|oled)\b"),
    ("audio", r"\b(auricular|auriculares|headset|headphone|earbuds?)\b"),
    ("mic", r"\b(microfono|microphone|mic)\b"),
    ("cam", r"\b(webcam|camera|camara|cam)\b"),
)
#: Category by the first keyword found in a lower-case name, in this order.
CATEGORY_KEYWORDS = (
    ("procesadores", ("ryzen", "core i", "procesador")),
    ("tarjetas-graficas", ("rtx", "radeon", "geforce", "placa de video")),
    ("motherboards", ("mother", "placa madre")),
    ("memoria-ram", ("ddr4", "ddr5", "ram")),
    ("almacenamiento", ("ssd", "nvme", "hdd")),
    ("fuentes-alimentacion", ("fuente", "psu")),
    ("gabinetes", ("gabinete", "case")),
    ("refrigeracion", ("cooler", "refrigeracion", "ventilador")),
)
DETAIL_KEYWORDS = (
    ("tarjetas-graficas", ("rtx", "radeon", "geforce", "rx ", "placa de video", "gpu")),
    ("procesadores", ("ryzen", "core i", "core-i", "ultra ", "procesador", "cpu")),
    ("motherboards", ("mother", "placa madre")),
    ("memoria-ram", ("ddr4", "ddr5", "ram")),
    ("almacenamiento", ("ssd", "nvme", "hdd", "disco")),
    ("fuentes-alimentacion", ("fuente", "psu")),
    ("gabinetes", ("gabinete", "case")),
    ("refrigeracion", ("cooler", "refrigeracion", "ventilador")),
)
#: Heuristic titles (upper case).
TITLE_STOPWORDS = "DE DEL LA EL LOS LAS Y CON PARA POR UN UNA NO INCLUYE INCLUIR SIN EN AL".split()
TITLE_NOISE = (
    "PROCESADOR MICRO CPU PLACA VIDEO VGA MOTHERBOARD MOTHER MEMORIA RAM GAMER OFERTA OEM BOX NVIDIA GEFORCE RADEON GRAPHICS "
    "CARD EDITION OC PCI PCIE PCI-E SERIES"
).split()
TITLE_BRANDS = (
    r"ASUS|GIGABYTE|MSI|ZOTAC|PALIT|INNO3D|ASROCK|PNY|XFX|SAPPHIRE|AMD|INTEL|KINGSTON|CORSAIR|G\.?SKILL|TEAMGROUP|CRUCIAL|"
    "PATRIOT|ADATA|XPG|SAMSUNG|SEAGATE|WD"
)
TITLE_GPU = r"RTX\s*\d{3,4}(?:\s*(?:TI|SUPER))?|GTX\s*\d{3,4}(?:\s*(?:TI|SUPER))?|RX\s*\d{3,4}(?:\s*XT)?|ARC\s*[A-Z]?\s*\d{3}"
TITLE_CPU = r"RYZEN\s*[3579]\s*\d{3,5}[A-Z0-9]{0,3}|CORE\s*I[3579]\s*\d{4,5}[A-Z]{0,2}|PENTIUM\s*[A-Z0-9]+|CELERON\s*[A-Z0-9]+"
TITLE_VARIANTS = (
    "DUAL TUF PRIME EAGLE WINDFORCE VENTUS SHADOW INFINITY GAMING AERO STRIX SUPRIM TRINITY CHALLENGER PULSE NITRO STEEL TOMAHAWK"
).split()
FINGERPRINT_BRAND = "asus|gigabyte|msi|zotac|palit|inno3d|asrock|pny|xfx|sapphire|amd|intel"
FINGERPRINT_CHIP = (
    r"rtx\s*\d{3,4}(?:\s*(?:ti|super))?|rx\s*\d{3,4}(?:\s*xt)?|ryzen\s*[3579]\s*\d{3,5}(?:x3d|gt|ge|xt|x|g|f)?|"
    r"core\s*i[3579]\s*\d{4,5}[a-z]{0,2}"
)
#: Latin letters with a mark, and the letters without; covers Spanish, French, German and Portuguese.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
TRACKING_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid ref".split()
#: Brands looked for in a name, in this order, with the names they are shown by.
NAME_BRANDS = (
    ("AMD", "AMD"), ("INTEL", "Intel"), ("ASUS", "ASUS"), ("GIGABYTE", "Gigabyte"), ("MSI", "MSI"), ("CORSAIR", "Corsair"),
    ("NVIDIA", "NVIDIA"), ("GEFORCE", "NVIDIA"), ("RADEON", "AMD Radeon"),
)
DEFAULT_BRAND = "Generica"
PC_BUILD_TERMS = (
    "pc gamer", "combo", "armado", "pc completa", "computadora", "desktop", "workstation", "notebook", "laptop", "all in one", "aio ",
    "netbook", "chromebook", "kit ", "bundle", "paquete", "gaming pc", "cpu +", "procesador +", "usado", "refurbished", "open box",
    "reacondicionado", "segunda mano",
)
PERIPHERAL_NAMES = (
    "mouse|teclad|keyboard|monitor|auricular|headset|headphone|parlante|speaker|microfono|webcam|joystick|gamepad|mousepad|alfombrilla|"
    "logitech|razer|redragon|steelseries|keychron"
)
COMPONENT_NAMES = (
    r"rtx|gtx|rx\s*[0-9]{3,4}|radeon|geforce|ryzen|core\s*i[3579]|mother|placa\s*madre|ddr4|ddr5|ssd|nvme|hdd|fuente|gabinete|cooler|ventilador"
)
AVAILABILITY = {
    "in-stock": "https://schema.org/InStock", "low-stock": "https://schema.org/InStock", "out-of-stock": "https://schema.org/OutOfStock",
}
OTHER_AVAILABILITY = "https://schema.org/LimitedAvailability"
SHORT_TITLE, META_TEXT = 46, 160
CARD_DROP_PERCENT = 5
#: Terms by which a feed's component is of a category.
COMPONENT_TERMS = {
    "procesadores": ("procesador",), "tarjetas-graficas": ("placa de video",), "motherboards": ("placa madre", "motherboard", "mother"), "memoria-ram": ("ram", "memoria"),
    "almacenamiento": ("ssd", "disco", "almacenamiento"), "fuentes-alimentacion": ("fuente", "psu"), "gabinetes": ("gabinete", "case"), "refrigeracion": ("refrigeracion", "cooler"),
    "perifericos": ("monitor", "mouse", "teclado", "auricular", "microfono", "parlante", "mousepad"),
}
#: Fixed public pages: path, how often they change, priority.
PUBLIC_PAGES = (
    ("/", "hourly", 1.0), ("/acerca", "monthly", 0.3), ("/about", "monthly", 0.2), ("/contacto", "monthly", 0.3), ("/privacidad", "monthly", 0.2), ("/terminos", "monthly", 0.2),
    ("/comparativa", "daily", 0.9), ("/guia", "daily", 0.9),
)
#: Rows that the fallback search looks at.
FALLBACK_LIMIT = 250
