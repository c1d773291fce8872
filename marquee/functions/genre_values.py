"""Genres of books by classification: fixed values."""

#: Genres of the classes of the Library of Congress. Of several beginnings of a class the longest counts.
LCC_GENRES = {
    "A": ["reference"],
    "B": ["philosophy"],
    "BC": ["philosophy"],
    "BD": ["philosophy"],
    "BF": ["psychology"],
    "BH": ["philosophy"],
    "BJ": ["philosophy"],
    "BL": ["religion"],
    "BM": ["religion"],
    "BP": ["religion"],
    "BQ": ["religion"],
    "BR": ["religion"],
    "BS": ["religion"],
    "BT": ["religion"],
    "BV": ["religion"],
    "BX": ["religion"],
    "C": ["history"],
    "CT": ["biography"],
    "D": ["history"],
    "E": ["history"],
    "F": ["history"],
    "G": ["geography-travel"],
    "GN": ["social-sciences"],
    "GR": ["social-sciences"],
    "GV": ["sports-recreation"],
    "H": ["social-sciences"],
    "HB": ["economics-business"],
    "HC": ["economics-business"],
    "HD": ["economics-business"],
    "HE": ["economics-business"],
    "HF": ["economics-business"],
    "HG": ["economics-business"],
    "HJ": ["economics-business"],
    "J": ["political-science"],
    "K": ["law"],
    "L": ["education"],
    "M": ["music"],
    "N": ["art"],
    "P": ["language"],
    "PA": ["literature"],
    "PB": ["language"],
    "PC": ["language"],
    "PD": ["language"],
    "PE": ["language"],
    "PF": ["language"],
    "PG": ["literature"],
    "PH": ["language"],
    "PJ": ["literature"],
    "PK": ["literature"],
    "PL": ["literature"],
    "PM": ["language"],
    "PN": ["literature"],
    "PQ": ["literature"],
    "PR": ["literature"],
    "PS": ["literature"],
    "PT": ["literature"],
    "PZ": ["fiction"],
    "Q": ["science"],
    "QA": ["mathematics"],
    "R": ["medicine-health"],
    "S": ["agriculture"],
    "T": ["technology"],
    "TX": ["cooking"],
    "U": ["military-naval"],
    "V": ["military-naval"],
    "Z": ["library-information-science"],
}
#: Class PZ from this number on is for young readers, and its genres.
PZ_YOUNG_FROM = 5.0
PZ_YOUNG_GENRES = ["fiction", "childrens-young-adult"]

#: Genres of Dewey numbers by their first digits, of which the longest count.
DDC_GENRES = {
    "0": ["reference"],
    "004": ["computing"],
    "005": ["computing"],
    "006": ["computing"],
    "1": ["philosophy"],
    "15": ["psychology"],
    "158": ["self-help"],
    "2": ["religion"],
    "3": ["social-sciences"],
    "4": ["language"],
    "5": ["science"],
    "6": ["technology"],
    "641": ["cooking"],
    "7": ["art"],
    "78": ["music"],
    "796": ["sports-recreation"],
    "9": ["history"],
    "91": ["geography-travel"],
    "92": ["biography"],
    "920": ["biography"],
    "929": ["history"],
}
#: Literary forms by the third digit of an 8xx number, other than 80x.
DDC_FORMS = {"1": "poetry", "2": "drama", "3": "fiction", "4": "essays"}
#: Genres of the marks in brackets that stand for a number.
DDC_MARKS = {"fic": ["fiction"], "e": ["childrens-young-adult"]}

#: Genres of subjects.
SUBJECT_GENRES = {
    "agriculture": ["agriculture"],
    "art": ["art"],
    "autobiography": ["biography"],
    "biographies": ["biography"],
    "biography": ["biography"],
    "business": ["economics-business"],
    "business & economics": ["economics-business"],
    "children's fiction": ["fiction", "childrens-young-adult"],
    "children's literature": ["childrens-young-adult"],
    "children's stories": ["childrens-young-adult"],
    "christianity": ["religion"],
    "computer science": ["computing"],
    "computers": ["computing"],
    "conduct of life": ["self-help"],
    "cookbooks": ["cooking"],
    "cookery": ["cooking"],
    "cooking": ["cooking"],
    "description and travel": ["geography-travel"],
    "drama": ["drama"],
    "economics": ["economics-business"],
    "education": ["education"],
    "essays": ["essays"],
    "fiction": ["fiction"],
    "finance": ["economics-business"],
    "games": ["sports-recreation"],
    "geography": ["geography-travel"],
    "health": ["medicine-health"],
    "health & fitness": ["medicine-health"],
    "history": ["history"],
    "juvenile fiction": ["fiction", "childrens-young-adult"],
    "juvenile literature": ["childrens-young-adult"],
    "language": ["language"],
    "languages": ["language"],
    "law": ["law"],
    "literary fiction": ["fiction", "literature"],
    "literature": ["literature"],
    "management": ["economics-business"],
    "mathematics": ["mathematics"],
    "medicine": ["medicine-health"],
    "memoirs": ["biography"],
    "military history": ["history", "military-naval"],
    "music": ["music"],
    "nature": ["science"],
    "novel": ["fiction"],
    "novels": ["fiction"],
    "philosophy": ["philosophy"],
    "plays": ["drama"],
    "poetry": ["poetry"],
    "political science": ["political-science"],
    "politics": ["political-science"],
    "programming": ["computing"],
    "psychology": ["psychology"],
    "reference": ["reference"],
    "religion": ["religion"],
    "science": ["science"],
    "self-help": ["self-help"],
    "self-help techniques": ["self-help"],
    "social science": ["social-sciences"],
    "social sciences": ["social-sciences"],
    "sociology": ["social-sciences"],
    "spirituality": ["religion"],
    "sports": ["sports-recreation"],
    "sports & recreation": ["sports-recreation"],
    "technology": ["technology"],
    "travel": ["geography-travel"],
    "voyages and travels": ["geography-travel"],
    "young adult fiction": ["fiction", "childrens-young-adult"],
}
