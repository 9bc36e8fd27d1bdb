"""Names, lists and patterns of the domain."""

from __future__ import annotations

# They must be these for right results.

#: The seven fields, in the order of reports.
FIELDS = ["shipper", "consignee", "notify_party", "port_of_loading", "port_of_discharge", "container_count", "gross_weight_kg"]
PARTIES = FIELDS[:3]
PORTS = FIELDS[3:5]

CATEGORIES = ["BL_COMPARISON", "GENERAL", "INVOICE_QUERY", "SI_REQUEST", "SPAM"]

#: Labels at a line's start, by field; white space within them may be missing.
LABELS = {
    "shipper": r"shipper(?:\s*\(principal\s*or\s*seller\))?(?:/exporter)?",
    "consignee": r"(?:consignee(?:\s*\(non-negotiable\))?|to\s*the\s*order\s*of)",
    "notify_party": r"notify(?:\s*party)?(?:/intermediate\s*consignee)?",
    "port_of_loading": r"(?:port\s*of\s*loading(?:\s*\(pol\))?|load\s*port|pol\b)",
    "port_of_discharge": r"(?:port\s*of\s*discharge(?:\s*\(pod\))?|discharge\s*port|pod\b)",
    "container_count": r"(?:(?:total\s*)?no\.?\s*of\s*containers(?:\s*or\s*packages)?|total\s*containers|container\s*count|containers)",
    "gross_weight_kg": r"(?:total\s*)?gross\s*(?:weight|wt)(?:\s*\(kgs?\))?",
}
#: What scanned labels are likened to, letters only.
LABEL_ALIASES = [
    ("shipper", "shipper"),
    ("consignee", "consignee"),
    ("consignee", "totheorderof"),
    ("notify_party", "notify"),
    ("notify_party", "notifyparty"),
    ("port_of_loading", "portofloading"),
    ("port_of_loading", "loadport"),
    ("port_of_loading", "pol"),
    ("port_of_discharge", "portofdischarge"),
    ("port_of_discharge", "dischargeport"),
    ("port_of_discharge", "pod"),
    ("container_count", "containers"),
    ("container_count", "noofcontainers"),
    ("container_count", "containercount"),
    ("container_count", "totalcontainers"),
    ("gross_weight_kg", "grossweight"),
    ("gross_weight_kg", "grosswt"),
]
NET_WEIGHT = r"(?i)^\s*net\s*(weight|wt)"
#: A placeholder is a text of this form, or one with three underscores or question marks in a row.
PLACEHOLDER_FORM = r"(?i)^\s*(?:n/?a|tba|tbc|tbd|nil|none|-+|_+.*|\?+.*|\.+|x+|unknown)\s*$|^_+"
PLACEHOLDER = PLACEHOLDER_FORM + r"|_{3,}|\?{3,}"
CJK_GROUP = r"\([^)]*[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}][^)]*\)"
CJK_RUN = r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}\x{25a0}\x{25a1}\x{fffd}]+"

#: Company forms, rewritten in this order.
SUFFIXES = [
    (r"\bLIMITED\b", "LTD"),
    (r"\bCOMPANY\b", "CO"),
    (r"\bCORPORATION\b", "CORP"),
    (r"\bINCORPORATED\b", "INC"),
    (r"\bSDN ?BHD\b", "SDN BHD"),
    (r"\bPRIVATE\b", "PTE"),
    (r"\bFZ ?LLC\b", "FZLLC"),
]
PORT_ALIASES = {
    "PORT KELANG": "PORT KLANG",
    "PELABUHAN KLANG": "PORT KLANG",
    "PKG": "PORT KLANG",
    "HO CHI MINH": "HOCHIMINH CITY",
    "HO CHI MINH CITY": "HOCHIMINH CITY",
    "HOCHIMINH": "HOCHIMINH CITY",
    "HCMC": "HOCHIMINH CITY",
    "PYONGTAEK": "PYEONGTAEK",
    "PUSAN": "BUSAN",
    "THOOTHUKUDI": "TUTICORIN",
    "JAWAHARLAL NEHRU": "NHAVA SHEVA",
    "NHAVASHEVA": "NHAVA SHEVA",
}
COUNTRY_ALIASES = {
    "US": "USA",
    "UNITED STATES": "USA",
    "U S A": "USA",
    "UNITED ARAB EMIRATES": "UAE",
    "KOREA": "SOUTH KOREA",
    "REPUBLIC OF KOREA": "SOUTH KOREA",
}
NUMBER_WORDS = {
    "ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4, "FIVE": 5, "SIX": 6, "SEVEN": 7, "EIGHT": 8,
    "NINE": 9, "TEN": 10, "ELEVEN": 11, "TWELVE": 12, "FIFTEEN": 15, "TWENTY": 20,
}
POUND_KG = 0.45359237
WEIGHT_TOLERANCE_KG = 0.5
NEAR_MISS = 80
SNAP_NAME, SNAP_LEAD, SNAP_PLACE, SNAP_PREFIX = 88, 4, 85, 5
LABEL_LIKENESS = 85
TITLE_LINES = 8

BANNER = r"(?is)^\s*WARNING: This email originated outside.*?(?:\n\s*\n|$)"
SPAM = (
    r"(?i)congratulations|claim your|limited time offer|buy now|bank officer|urgent business proposal|"
    r"unpaid customs fee|you have won|verify your account|storage limit|mailbox has exceeded|"
    r"bitcoin|guaranteed|% off|undelivered messages|bit\.ly|track-parcel|webmail-verify|free-iphone|"
    r"gift card|survey and pay"
)
COMPARE = (
    r"(?is)(compare|check|verify|confirm).{0,60}\b(si|shipping instruction)\b.{0,40}\b(bl|bill of lading)\b|"
    r"\b(si|shipping instruction)\b.{0,40}\b(and|against|with)\b.{0,30}\b(draft )?(bl|bill of lading)\b|"
    r"check the draft bl against the si"
)
ASK_SEND = r"(?i)(assist|please|kindly)?.{0,20}\bsend\b.{0,20}draft bl"
INSTRUCTION_BODY = r"(?i)shipping instruction for"
INSTRUCTION_POL = r"\bPOL\s*:"
INSTRUCTION_SHIPPER = r"(?i)Shipper\s*:"
INVOICE = r"(?i)\binvoice\b|\bGR\b.{0,30}missing|\bTHC\b|local charge|D&D|detention|reverse the PGI"
INVOICE_SUBJECT = r"(?i)billing|freight|invoice"
#: Kind of a document by its title, capital letters and slashes only, first match.
TITLES = [
    (r"SHIPPINGINSTRUCTION|BLINSTRUCTION|B/LINSTRUCTION|BILLOFLADINGINSTRUCTION", "SI"),
    (r"PACKINGLIST", "OTHER:packing_list"),
    (r"CERTIFICATEOFORIGIN", "OTHER:certificate_of_origin"),
    (r"COMMERCIALINVOICE", "OTHER:commercial_invoice"),
    (r"BILLOFLADING|^B/L|\bBL\b", "BL"),
]
FIELD_NAMES = {
    "shipper": "Shipper",
    "consignee": "Consignee",
    "notify_party": "Notify party",
    "port_of_loading": "Port of loading",
    "port_of_discharge": "Port of discharge",
    "container_count": "Number of containers",
    "gross_weight_kg": "Gross weight",
}
EMAIL_EXTENSIONS = ["eml", "msg"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "heic", "heif", "tif", "tiff", "bmp"]
DOCUMENT_EXTENSIONS = ["txt", "pdf", "docx", "xlsx", "xlsm", *IMAGE_EXTENSIONS]
URGENT, REVIEW_PAGE, EXPLORER_PAGE = 5, 10, 20
