"""The country rules, in the order that decides ties.

Each rule is (pattern, country, points, whole word). A whole-word pattern is plain text that
must stand alone; any other pattern is a regular expression on lower-cased text.
"""

COUNTRY_RULES: tuple[tuple[str, str, int, bool], ...] = (
    ("survey of india", "india", 20, False),
    ("published by the survey of india", "india", 20, False),
    ("printed at the survey of india", "india", 20, False),
    ("surveyor general of india", "india", 20, False),
    ("dehra dun", "india", 12, False),
    ("dehradun", "india", 12, False),
    (r"s\.o\.i\.", "india", 12, False),
    ("uttar pradesh", "india", 8, False),
    ("madhya pradesh", "india", 8, False),
    ("andhra pradesh", "india", 8, False),
    ("himachal pradesh", "india", 8, False),
    ("arunachal pradesh", "india", 8, False),
    ("west bengal", "india", 8, False),
    ("tamil nadu", "india", 8, False),
    ("rajasthan", "india", 5, True),
    ("maharashtra", "india", 5, True),
    ("karnataka", "india", 5, True),
    ("telangana", "india", 5, True),
    ("jharkhand", "india", 5, True),
    ("chhattisgarh", "india", 5, True),
    ("uttarakhand", "india", 5, True),
    ("uttaranchal", "india", 5, True),
    ("manipur", "india", 5, True),
    ("meghalaya", "india", 5, True),
    ("mizoram", "india", 5, True),
    ("nagaland", "india", 5, True),
    ("tripura", "india", 5, True),
    ("assam", "india", 5, True),
    ("odisha", "india", 5, True),
    ("orissa", "india", 5, True),
    ("haryana", "india", 5, True),
    ("gujarat", "india", 5, True),
    ("kerala", "india", 5, True),
    ("sikkim", "india", 5, True),
    ("ballia", "india", 8, True),
    ("allahabad", "india", 5, True),
    ("prayagraj", "india", 5, True),
    ("varanasi", "india", 5, True),
    ("benares", "india", 5, True),
    ("lucknow", "india", 5, True),
    ("kanpur", "india", 5, True),
    ("cawnpore", "india", 5, True),
    ("agra", "india", 3, True),
    ("mathura", "india", 5, True),
    ("meerut", "india", 5, True),
    ("bareilly", "india", 5, True),
    ("gorakhpur", "india", 5, True),
    ("jhansi", "india", 5, True),
    ("gwalior", "india", 5, True),
    ("patna", "india", 5, True),
    ("muzaffarpur", "india", 5, True),
    ("darbhanga", "india", 5, True),
    ("bhagalpur", "india", 5, True),
    ("kolkata", "india", 5, True),
    ("calcutta", "india", 5, True),
    ("howrah", "india", 5, True),
    ("darjeeling", "india", 5, True),
    ("mumbai", "india", 5, True),
    ("bombay", "india", 5, True),
    ("pune", "india", 5, True),
    ("poona", "india", 5, True),
    ("nagpur", "india", 5, True),
    ("aurangabad", "india", 5, True),
    ("ahmedabad", "india", 5, True),
    ("surat", "india", 3, True),
    ("baroda", "india", 5, True),
    ("vadodara", "india", 5, True),
    ("jaipur", "india", 5, True),
    ("jodhpur", "india", 5, True),
    ("udaipur", "india", 5, True),
    ("bikaner", "india", 5, True),
    ("hyderabad", "india", 3, True),
    ("secunderabad", "india", 5, True),
    ("bangalore", "india", 5, True),
    ("mysore", "india", 5, True),
    ("madras", "india", 5, True),
    ("chennai", "india", 5, True),
    ("coimbatore", "india", 5, True),
    ("madurai", "india", 5, True),
    ("simla", "india", 5, True),
    ("shimla", "india", 5, True),
    ("mussoorie", "india", 5, True),
    ("nainital", "india", 5, True),
    ("naini tal", "india", 5, False),
    ("almora", "india", 5, True),
    ("bhopal", "india", 5, True),
    ("indore", "india", 5, True),
    ("jabalpur", "india", 5, True),
    ("raipur", "india", 5, True),
    ("amritsar", "india", 5, True),
    ("ludhiana", "india", 5, True),
    ("ganga", "india", 5, True),
    ("yamuna", "india", 5, True),
    ("jumna", "india", 5, True),
    ("brahmaputra", "india", 5, True),
    ("godavari", "india", 5, True),
    ("narmada", "india", 5, True),
    ("chambal", "india", 5, True),
    ("ghats", "india", 3, True),
    ("deccan", "india", 5, True),
    ("vindhya", "india", 5, True),
    ("himalaya", "india", 5, True),
    ("himalayas", "india", 5, True),
    ("district", "india", 2, True),
    ("survey of pakistan", "pakistan", 20, False),
    (r"s\.o\.p\.", "pakistan", 12, False),
    ("islamabad", "pakistan", 8, True),
    ("rawalpindi", "pakistan", 8, True),
    ("peshawar", "pakistan", 8, True),
    ("peshawur", "pakistan", 8, True),
    ("lahore", "pakistan", 8, True),
    ("karachi", "pakistan", 8, True),
    ("quetta", "pakistan", 8, True),
    ("multan", "pakistan", 8, True),
    ("faisalabad", "pakistan", 8, True),
    ("lyallpur", "pakistan", 8, True),
    ("ordnance survey", "uk", 20, False),
    ("published by ordnance", "uk", 20, False),
    ("crown copyright", "uk", 12, False),
    (r"o\.s\. sheet", "uk", 12, False),
    ("great britain", "uk", 8, False),
    ("northern ireland", "uk", 8, False),
    ("scotland", "uk", 5, True),
    ("england", "uk", 5, True),
    ("wales", "uk", 3, True),
    (r"u\.s\. geological survey", "usa", 20, False),
    ("united states geological", "usa", 20, False),
    ("usgs", "usa", 12, True),
    ("department of the interior", "usa", 12, False),
    ("quadrangle", "usa", 8, True),
    ("united states", "usa", 8, False),
    ("topographische karte", "germany", 20, False),
    ("landesvermessung", "germany", 20, False),
    ("messtischblatt", "germany", 20, False),
    ("bayerisches landesamt", "germany", 12, False),
    ("bundesrepublik", "germany", 8, False),
    ("institut géographique", "france", 20, False),
    ("institut geographique", "france", 20, False),
    ("carte de france", "france", 20, False),
    ("service géographique", "france", 20, False),
    ("service geographique", "france", 20, False),
    ("ign", "france", 12, True),
    ("république française", "france", 8, False),
    ("republique francaise", "france", 8, False),
)

# Fixed value: sheet numbers such as "72 C/01", "45D/7" or "NI-44-6" in the original case.
SHEET_NUMBER = r"\b(?:\d{1,3}\s*[A-Z](?:/\d{1,2})?|[A-Z]{1,2}-\d{2}-\d{1,2})\b"
