"""Fixed values for event typing: rules in priority order, word lists, source tiers.

The patterns, labels, signs, weights and lists below are fixed values: results are right only if they are
exactly these. All patterns are matched without regard to case unless the name says otherwise.
"""

# type, label, direction, base materiality, patterns; the first rule with a match decides
RULES = [
    ("routine", "Routine filing", 0, 0.03, [
        r"trading window", r"newspaper (publication|advertisement)", r"certificate under (sebi|regulation)",
        r"loss of share certificate", r"duplicate share", r"transmission of shares", r"\bESOP\b|\bESOS\b",
        r"investor (meet|presentation|conference)|analysts?\s*/?\s*institutional investor meet|earnings call",
        r"record date", r"shareholders?\s*meeting|\bAGM\b|\bEGM\b|postal ballot|e-?voting",
        r"compliance certificate|reconciliation of share capital|statement of deviation",
        r"intimation of (board meeting|closure)", r"board meeting intimation"]),
    ("clarification", "Exchange clarification", 0, 0.10, [
        r"news verification", r"clarification (sought|on|regarding)", r"spurt in (volume|price)", r"price movement"]),
    ("analyst_rating", "Analyst rating change", 0, 0.30, [
        r"\b(upgrade[sd]?|downgrade[sd]?)\b(?![^.]{0,20}\bcredit)", r"initiates? coverage",
        r"(price )?target (price )?(raised|cut|hiked|lowered|revised)",
        r"\b(raises?|cuts?|hikes?|lowers?)\b[^.]{0,20}\btarget price",
        r"\b(buy|sell|hold|overweight|underweight|outperform|underperform|neutral) (rating|call)\b"]),
    ("order_cancellation", "Order cancelled", -1, 0.60, [
        r"(order|contract|loa|letter of award|project)s?\b[^.]{0,60}\b(cancel\w*|terminat\w*|withdraw\w*|revok\w*|scrap\w*|foreclos\w*|short[- ]?clos\w*)",
        r"(cancel\w*|terminat\w*|revocation|foreclosure)\s+of\s+(the\s+)?(order|contract|loa|letter of award|project)"]),
    ("order_win", "Order win", 1, 0.45, [
        r"\b(bag|bags|bagged|win|wins|won|secure[sd]?|securing|receive[sd]?|receipt of|award(ed|s)?|bags?)\b[^.]{0,80}\b(orders?|contracts?|projects?|loa|letter of (award|acceptance|intent)|purchase orders?|work orders?|mandates?)\b",
        r"\b(orders?|contracts?)\b[^.]{0,30}\b(worth|valued at|value of|aggregating|amounting)\b",
        r"\bL-?1\s+bidder\b", r"letter of (award|acceptance|intent)|\bLoA\b|\bLoI\b",
        r"new orders?\b", r"order (inflow|book)\b[^.]{0,40}\b(rise|rises|jump|grow|record|strong)"]),
    ("guidance_change", "Guidance change", 0, 0.65, [
        r"\bguidance\b",
        r"\b(raises?|lifts?|ups|hikes?|cuts?|lowers?|trims?|revises?|reiterates?|maintains?)\b[^.]{0,30}\b(outlook|forecast|target|estimate)s?\b",
        r"\b(revenue|margin|growth|volume)\s+(outlook|target)\b"]),
    ("partnership", "Partnership / licensing", 1, 0.35, [
        r"\btie[- ]?up\b", r"\bpartner(s|ship|ed|ing)?\b(?! (with|in) (the )?(us|our))", r"collaborat\w+",
        r"strategic alliance", r"\bMoU\b|memorandum of understanding",
        r"voluntary licen[cs]e|licen[cs]ing (deal|agreement|pact)|licen[cs]e agreement|in-licen[cs]",
        r"distribution (deal|agreement|pact|rights)|exclusive (deal|agreement|rights|distribution)"]),
    ("earnings", "Earnings", 0, 0.55, [
        r"financial results?", r"\bresults? for the (quarter|half|year|period)", r"\bQ[1-4]\s*(FY)?\s*'?\d{0,4}\b",
        r"quarterly (results?|earnings|numbers)", r"\b(net )?profit\b|\bPAT\b|\bEBITDA\b|\bearnings\b",
        r"\brevenue\b[^.]{0,30}\b(rise|rises|jump|grow|fall|falls|decline|up|down)", r"outcome of board meeting"]),
    ("capacity_expansion", "Capacity / capex", 1, 0.40, [
        r"capacity (expansion|addition|enhancement|increase)", r"\bcommission(ed|ing|s)?\b",
        r"(new|greenfield|brownfield) (plant|facility|unit|line|factory|capacity)",
        r"commercial (production|operations?)|\bCOD\b|start(s|ed)? (production|operations)",
        r"\bcapex\b", r"\bexpan(d|ds|sion)\b[^.]{0,40}\b(capacity|plant|facility|unit)"]),
    ("regulatory_action", "Regulatory action", -1, 0.60, [
        r"show[- ]cause notice", r"\b(penalty|penalties|fined|penalised|penalized)\b",
        r"\b(raid|search|survey) (operation|by|at)\b", r"\b(income tax|GST|tax) (demand|notice|order)",
        r"\bdemand (order|notice)\b",
        r"warning letter|import alert|\bOAI\b|form 483|\b483 observations?|observations? from (the )?(us)?fda",
        r"\b(sebi|rbi|cci|nclt|ed|cbi)\b[^.]{0,40}\b(order|probe|investigat\w*|penalty|ban|bars?|restrain\w*|notice|action)",
        r"\b(debar\w*|suspend\w*|suspension|ban(s|ned)?)\b", r"insolvency|\bCIRP\b|winding up"]),
    ("regulatory_approval", "Regulatory approval", 1, 0.45, [
        r"(us)?fda\b[^.]{0,40}\b(approval|nod|clearance|eir|no observations|zero observations|vai|nai)",
        r"\b(receives?|gets?|secures?|obtain(s|ed)?)\b[^.]{0,40}\b(approval|nod|licen[cs]e|clearance|registration)\b",
        r"establishment inspection report|\bEIR\b"]),
    ("pledge_released", "Pledge released", 1, 0.40, [
        r"(release|revocation|revoke[sd]?)\s+of\s+(the\s+)?(pledge|encumbrance)",
        r"pledge(d)?\s+(shares\s+)?(released|revoked)"]),
    ("pledge_created", "Pledge created / invoked", -1, 0.50, [
        r"(creation|invocation)\s+of\s+(the\s+)?(pledge|encumbrance)",
        r"pledge(s|d)?\b[^.]{0,30}\b(created|invoked|increase\w*)", r"\bencumbrance\b", r"\bpledg(e|es|ed|ing)\b"]),
    ("promoter_buy", "Promoter buying", 1, 0.50, [
        r"promoters?\b[^.]{0,40}\b(buy|buys|bought|acquire[sd]?|purchase[sd]?|raise[sd]? stake|hike[sd]? stake|increase[sd]? stake|creeping)",
        r"(acquisition|purchase) of shares by (the )?promoter"]),
    ("promoter_sell", "Promoter selling", -1, 0.50, [
        r"promoters?\b[^.]{0,40}\b(sell|sells|sold|offload\w*|divest\w*|trim\w*|cut[s]? stake|pare[sd]? stake|reduce[sd]? stake|block deal|offer for sale|\bOFS\b)",
        r"\bOFS\b|offer for sale"]),
    ("fund_raising", "Fund raising", 0, 0.40, [
        r"\bQIP\b|qualified institutions? placement", r"preferential (issue|allotment)", r"rights issue",
        r"fund[- ]?rais\w*|rais(e|es|ed|ing) (up to )?(₹|rs\.?|inr|\$|funds|capital)",
        r"\bNCDs?\b|non-convertible debentures?", r"\bwarrants?\b", r"\bFCCBs?\b"]),
    ("management_change", "Management change", 0, 0.30, [
        r"\bresign\w*\b", r"steps? down",
        r"\b(appoint\w*|cessation|re-?designat\w*|elevat\w*|names?|named)\b[^.]{0,50}\b(ceo|cfo|md|managing director|chairman|chief|director|kmp|auditor|company secretary)\b",
        r"\b(ceo|cfo|md|managing director|chairman|chief \w+ officer|director|kmp|auditor|company secretary)\b[^.]{0,30}\b(appoint\w*|cessation)\b"]),
    ("mna", "M&A / restructuring", 0, 0.50, [
        r"\b(acquisition|acquires?|acquired|takeover|merger|amalgamation|demerger|scheme of arrangement|divestment|stake sale|joint venture|\bJV\b)\b"]),
    ("buyback", "Buyback", 1, 0.50, [r"\bbuy-?back\b"]),
    ("credit_rating", "Credit rating", 0, 0.30, [
        r"credit rating|\brating\b[^.]{0,30}\b(upgrade|downgrade|reaffirm|revis)",
        r"\b(upgrade|downgrade)[sd]?\b[^.]{0,20}\brating"]),
    ("dividend", "Dividend / bonus / split", 1, 0.15, [
        r"\bdividend\b", r"\bbonus (issue|shares)\b", r"stock split|sub-?division"]),
    ("price_commentary", "Price commentary", 0, 0.02, [
        r"\b(shares?|stocks?|scrip|share price|stock price)\b[^.]{0,40}\b(rise|rises|rose|gain|gains|gained|jump|jumps|jumped|surge|surges|surged|soar|soars|soared|climb|climbs|climbed|rall(y|ies|ied)|fall|falls|fell|drop|drops|dropped|slip|slips|slipped|slide|slides|decline|declines|declined|tumble|tumbles|plunge|plunges|sink|sinks|trade|trades|trading|up|down|higher|lower|flat|hold|holds|consolidate\w*)\b",
        r"straight session|(fall|losing|winning|gaining) streak", r"top (gainers|losers)", r"52[- ]week (high|low)",
        r"double (top|bottom)|\bsupport\b|\bresistance\b|breakout|live levels|technical (view|outlook|chart|analysis)",
        r"stock (analysis|forecast|outlook)|share price (today|target|forecast|live)|price,? valuation|holds at \$|stocks? to (buy|watch)"]),
]
OTHER = ("other", "Other news", 0, 0.15)
COMPANY_UPDATE = ("company_update", "Company update", 0, 0.25)

TONE_TYPES = ["earnings", "guidance_change", "credit_rating", "analyst_rating", "mna", "other", "company_update"]
NEVER_REPEATS = ["routine", "price_commentary"]
SIZE_TYPES = ["promoter_buy", "promoter_sell", "mna", "buyback"]
ORDER_TYPES = ["order_win", "order_cancellation"]

POSITIVE = r"\b(rise|rises|rose|jump|jumps|jumped|surge|surges|surged|soar|soars|grow|grows|grew|growth|up|higher|beat|beats|record|strong|raise|raises|raised|upgrade[sd]?|improv\w*|expan\w*|profit(?! warning))\b"
NEGATIVE = r"\b(fall|falls|fell|drop|drops|dropped|decline|declines|declined|slump|slumps|plunge|plunges|down|lower|miss|misses|missed|weak|cut|cuts|lowered|downgrade[sd]?|loss|losses|contraction|warning|disappoint\w*)\b"
RUMOUR = r"\b(sources? said|sources|reportedly|report says|rumou?r|buzz|speculat\w*|in talks|likely to|may|might|could|plans? to|considering|mulls?|eyes|set to|expected to)\b"
SEVERE = r"warning letter|import alert|\bOAI\b|insolvency|\bCIRP\b|debar|ban(ned)?|raid|search operation|winding up"
SENIOR_EXIT = r"(resign\w*|steps? down|cessation)[^.]{0,60}\b(ceo|cfo|md|managing director|chief executive|chief financial|auditor)|\b(ceo|cfo|md|managing director|chief executive|chief financial|auditor)\b[^.]{0,60}(resign\w*|steps? down|cessation)"
AUDITOR_EXIT = r"auditor[^.]{0,40}resign|resign\w*[^.]{0,40}auditor"
DILUTIVE = r"preferential|QIP|rights|warrants|FCCB"

AMOUNT_CURRENCY = r"₹|rs\.?|inr|usd|us\$|\$|eur|€"
AMOUNT_NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?"
AMOUNT_UNIT = r"lakh crore|lakh cr|crores?|cr\b|lakhs?|lacs?|billion|bn\b|million|mn\b|mln\b|thousand crore"
AMOUNT_NOT_MONEY = r"\s*(?:equity\s+)?(?:shares?|units?|tonnes?|tons?|tpa|mtpa|mt\b|sq|kg|litres?|customers?|users?|subscribers?|people|jobs|vehicles?|doses?|barrels?)"
AMOUNT = rf"({AMOUNT_CURRENCY})?\s*({AMOUNT_NUMBER})\s*({AMOUNT_UNIT})?(?!{AMOUNT_NOT_MONEY})"

PERIOD = r"(?:execut\w*|complet\w*|deliver\w*|suppl\w*|implement\w*|tenure|period|duration|span\w*|over|within)[^.]{0,40}?(?:over|within|in|of)?\s*(?:a\s+(?:period|span)\s+of\s+)?(\d+(?:\.\d+)?)\s*(months?|years?|yrs?|days?|weeks?)"
BY_YEAR = r"\bby\s+(?:FY\s*'?(\d{2,4})|(?:march|mar)\s+(\d{4}))"
RUNNING_TOTAL = r"(ytd|year[- ]to[- ]date|order ?book|backlog|so far|cumulative|total|intake|beyond|till date|to date|for the year|in fy\d*|pipeline|bid pipeline)\W*(\w+\W+){0,3}$"
CLIENT_CASE_SENSITIVE = r"\b(?:from|by|with)\s+(?:the\s+)?((?:[A-Z][A-Za-z0-9&.\-]*|of|and|for)(?:\s+(?:[A-Z][A-Za-z0-9&.\-]*|of|and|for)){0,7})"
CLIENT_CONNECTORS = ["of", "and", "for"]
CLIENT_STOP = ["The", "Company", "Board", "Exchange", "BSE", "NSE", "Ltd", "Limited", "Rs", "INR", "Q1", "Q2", "Q3", "Q4",
               "FY", "Its", "This", "Order", "Contract", "March", "April", "September", "October"]

NOVELTY_STOP = ["the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "as", "is", "are",
                "its", "from", "ltd", "limited", "company", "has", "informed", "exchange", "regarding", "shares", "stock"]

TIER_ONE = ["livemint", "mint", "the economic times", "economic times", "moneycontrol", "moneycontrol.com",
            "cnbc tv18", "cnbctv18", "cnbc", "business standard", "ndtv profit", "bloomberg", "reuters",
            "financial express", "the hindu businessline", "businessline", "business today", "pti"]
WIRES = ["pr newswire", "business wire", "globenewswire", "prnewswire"]

# ---- headline de-duplication -----------------------------------------------------------------------
UP_WORDS = ["rise", "rises", "rising", "jump", "jumps", "jumping", "surge", "surges", "surging", "gain", "gains",
            "rally", "rallies", "rebound", "rebounds", "up", "climb", "climbs"]
DOWN_WORDS = ["fall", "falls", "falling", "drop", "drops", "dropping", "plunge", "plunges", "plunging", "slump",
              "slumps", "tumble", "tumbles", "decline", "declines", "down", "slide", "slides"]
TITLE_STOP = ["the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "as", "is", "are", "amid",
              "after", "its", "this", "that", "from", "be", "will", "has", "have", "can", "more", "over"]
SOURCE_TIERS = {
    "livemint": 10, "mint": 10, "the economic times": 10, "economic times": 10, "moneycontrol": 10,
    "moneycontrol.com": 10, "cnbc tv18": 9, "cnbc": 9, "business standard": 9, "ndtv profit": 9, "ndtv": 8,
    "bloomberg": 10, "reuters": 10, "financial express": 8, "business today": 8, "the hindu": 7,
    "the hindu business line": 8, "businessline": 8, "deccan herald": 7, "zee business": 7,
}
# Index and regulator names; company names come from an alias table that the caller passes.
COMMON_ALIASES = {
    "nifty": "NIFTY", "nifty 50": "NIFTY", "bank nifty": "BANKNIFTY", "sensex": "SENSEX", "rbi": "RBI", "sebi": "SEBI",
}
SAME_STORY_SIM = 0.85
SAME_STORY_SIM_WITH_NUMBER = 0.74
SAME_STORY_SIM_WITH_WORDS = 0.55
SAME_STORY_JACCARD = 0.40
NUMBER_TOLERANCE = 0.03
