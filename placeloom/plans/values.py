"""Fixed values of the request parser and the category expansion: results depend on them, and on their order."""

# Category and what names it in a request; the first category that occurs wins.
CATEGORIES = {
    "restaurant": [
        "restaurant", "restaurants", "resturent", "resuturant", "resturants", "restrant", "food place", "food places", "dining", "dining place", "dining places",
        "eatery", "eateries", "diner", "fast food", "fastfood", "pizza place", "ریسٹورنٹ", "کھانے", "کھانے کی جگہ",
    ],
    "hotel": ["hotel", "hotels", "hotle", "hotal", "lodging", "inn", "motel", "guest house", "accommodation", "ہوٹل", "رہائش"],
    "school": ["school", "schools", "sakool", "skool", "academy", "academies", "سکول", "تعلیمی", "مدرسہ"],
    "cafe": ["cafe", "cafes", "kafe", "cafi", "coffee shop", "coffee", "چائے", "کیفے"],
    "real estate agency": [
        "real estate", "agency", "agent", "property", "properties", "real estate agency", "realtor", "realtors", "dealer", "dealers", "پراپرٹی", "ایجنسی",
    ],
    "gym": ["gym", "gyms", "fitness", "fitness center", "جم", "gim", "jym"],
    "hospital": ["hospital", "hospitals", "medical center", "ہسپتال"],
    "clinic": ["clinic", "clinics", "کلینک"],
    "pharmacy": ["pharmacy", "pharmacies", "chemist", "drugstore", "medical store", "فارمیسی", "دوا"],
    "dentist": ["dentist", "dentists", "dental clinic", "dental", "دندان ساز"],
    "doctor": ["doctor", "doctors", "physician", "ڈاکٹر"],
    "bank": ["bank", "banks", "بینک"],
    "supermarket": ["supermarket", "supermarkets", "grocery", "groceries", "store", "سپر مارکیٹ"],
    "salon": ["salon", "salons", "barber", "barbershop", "hair salon", "beauty salon", "بیوٹی سیلون"],
    "college": ["college", "colleges", "institute", "کالج"],
    "university": ["university", "universities", "یونیورسٹی"],
    "mosque": ["mosque", "mosques", "masjid", "مسجد"],
    "church": ["church", "churches"],
    "software house": ["software house", "software company", "software companies", "it company", "tech company", "software firm", "software houses"],
    "bakery": ["bakery", "bakeries", "بیکری"],
}
# Cities in the order in which they are tried, each known by its own name in lower case ...
CITIES = [
    "Lahore", "Karachi", "Islamabad", "Rawalpindi", "Gujrat", "Gujranwala", "Faisalabad", "Sialkot", "Peshawar", "Multan", "Hyderabad", "Quetta", "Abbottabad", "Murree",
    "Bahawalpur", "Sargodha", "Sukkur", "Sahiwal", "Okara", "Kasur", "Jhelum", "Chakwal", "Attock", "Sheikhupura", "Rahim Yar Khan", "Mandi Bahauddin", "Dera Ghazi Khan",
    "Muzaffargarh", "Vehari", "Khanewal", "Jhang", "Toba Tek Singh", "Nankana Sahib", "Hafizabad", "Mianwali", "Pakpattan", "Narowal", "Bahawalnagar", "Layyah", "Rajanpur",
    "Chiniot", "Bhakkar", "Khushab", "Lodhran", "Larkana", "Mirpur Khas", "Nawabshah", "Thatta", "Badin", "Mardan", "Mansehra", "Kohat", "Nowshera", "Haripur",
    "Dera Ismail Khan", "Gwadar", "Gilgit", "Skardu", "Muzaffarabad", "Mirpur", "Chichawatni", "Depalpur", "Pattoki", "Taxila", "Burewala", "Mumbai", "Delhi", "Gujarat",
]
# ... and by these further names; the cities of another country.
CITY_NAMES = {
    "Lahore": ["لاہور"], "Karachi": ["کراچی"], "Islamabad": ["اسلام آباد", "اسلام اباد"], "Rawalpindi": ["pindi", "راولپنڈی"], "Gujrat": ["گجرات"], "Gujranwala": ["گجرانوالہ"],
    "Faisalabad": ["فیصل آباد", "فیصل اباد"], "Sialkot": ["سیالکوٹ"], "Peshawar": ["پشاور"], "Multan": ["ملتان"], "Sahiwal": ["ساہیوال"], "Okara": ["اوکاڑہ"], "Kasur": ["قصور"],
    "Jhelum": ["جہلم"], "Sheikhupura": ["شیخوپورہ"], "Dera Ghazi Khan": ["dg khan"], "Dera Ismail Khan": ["di khan"], "Mumbai": ["bombay"],
}
ABROAD = {"Mumbai": "India", "Delhi": "India", "Gujarat": "India"}
# Output fields and what asks for them.
FIELDS = {
    "phone": ["phone", "number", "contact", "contact number", "mobile", "call", "فون", "نمبر", "رابطہ", "fon", "nambar", "numbar"],
    "website": ["website", "url", "site", "web", "ویب", "سائٹ", "wabsait"],
    "address": ["address", "location", "where", "street", "پتہ", "ایڈریس", "pata", "patta"],
    "rating": ["rating", "ratings", "stars", "review", "reviews", "سٹار", "ستارے", "star"],
    "price": ["price", "cost", "قیمت", "روپے", "rupey", "rupai"],
    "email": ["email", "e-mail", "mail", "ای میل"],
    "opening_hours": ["hours", "timing", "opening hours", "schedule", "اوقات"],
    "review_count": ["review count", "number of reviews", "how many reviews"],
}
FIRST_FIELDS, DEFAULT_FIELDS = ["business_name", "category"], ["phone", "website", "rating", "address", "city"]
# Requests that are none, words before a place (or after it), words that are no place, and words for cheap.
UNSUPPORTED = ["write", "code", "game", "poem", "essay", "make a", "how to build", "create a", "build me", "program", "script", "function"]
PREPOSITIONS = [
    "inside", "around", "within", "near", "in", "at", "on", "main", "mein", "me", "ke qareeb", "ke paas", "ke nazdeek", "qareeb", "nazdeek", "paas", "andar",
]
NOISE = [
    "dhundo", "dhoondo", "dhoondho", "nikal", "nikaal", "batao", "batado", "chahiye", "chaheye", "karo", "do", "dena", "bana", "banao",
]
CHEAP = ["cheap", "budget", "affordable", "low cost", "سستا", "sasta"]
PRICE = r"(?:under|below|max|rs\.?|rupees?|کم|سستا|sasta|kam|budget|cheap)\s*([0-9]+)"
RATING = r"(?:rating|rated|above|min|سٹار|ستارے|star|stars|se ziyada|se upar)\s*([1-5]\.?[0-9]?)"
RATING_ABOVE = r"(?:above|over|more than|زیادہ)\s*([1-5]\.?[0-9]?)\s*(?:star|stars|rating|سٹار)"
# Other words for a category.
EXPANSIONS = {
    "mobile shop": ["mobile phone store", "cell phone store", "smartphone store", "mobile accessories"], "mobile shops": ["mobile phone stores", "cell phone stores", "smartphone stores"],
    "restaurant": ["food", "dining", "eatery", "diner", "food restaurant"], "restaurants": ["food places", "dining places", "eateries"],
    "pharmacy": ["medical store", "chemist", "medicine shop", "drugstore"], "pharmacies": ["medical stores", "chemists", "medicine shops"],
    "grocery store": ["grocery", "kirana store", "general store", "supermarket", "mini mart"], "grocery stores": ["groceries", "kirana stores", "general stores", "supermarkets"],
    "clothing shop": ["clothing store", "garments shop", "fashion store", "boutique", "dress shop"], "clothing shops": ["clothing stores", "garments shops", "fashion stores", "boutiques"],
    "electronics shop": ["electronics store", "electrical shop", "appliance store"], "electronics shops": ["electronics stores", "electrical shops", "appliance stores"],
    "hardware store": ["hardware shop", "building materials", "construction supplies"], "hardware stores": ["hardware shops", "building materials", "construction supplies"],
    "auto repair": ["mechanic", "auto workshop", "car repair", "garage", "vehicle repair"], "auto repair shop": ["mechanic shop", "auto workshop", "car garage", "vehicle repair shop"],
    "salon": ["beauty salon", "beauty parlour", "hair salon", "barber shop"], "salons": ["beauty salons", "beauty parlours", "hair salons", "barber shops"],
    "bakery": ["bakery shop", "bread shop", "cake shop", "pastry shop"], "bakeries": ["bakery shops", "bread shops", "cake shops", "pastry shops"],
    "school": ["educational institution", "academy", "madrasa", "college"], "schools": ["educational institutions", "academies", "colleges"],
    "hospital": ["medical center", "clinic", "health center", "healthcare"], "hospitals": ["medical centers", "clinics", "health centers"],
    "gas station": ["petrol pump", "fuel station", "petrol station", "CNG station"], "gas stations": ["petrol pumps", "fuel stations", "petrol stations"],
    "real estate": ["property dealer", "estate agent", "property agent", "housing"], "real estate agency": ["property dealer", "estate agent", "property agent"],
    "lawyer": ["advocate", "attorney", "legal consultant", "law firm"], "lawyers": ["advocates", "attorneys", "legal consultants", "law firms"],
    "doctor": ["physician", "medical specialist", "clinic doctor", "consultant"], "doctors": ["physicians", "medical specialists", "consultants"],
    "dentist": ["dental clinic", "dental surgeon", "tooth doctor"], "dentists": ["dental clinics", "dental surgeons"],
    "gym": ["fitness center", "fitness gym", "health club", "workout center"], "gyms": ["fitness centers", "fitness gyms", "health clubs"],
    "hotel": ["lodging", "guest house", "guesthouse", "motel"], "hotels": ["lodging", "guest houses", "motels"],
    "cafe": ["coffee shop", "coffee house", "tea cafe", "chai cafe"], "cafes": ["coffee shops", "coffee houses", "tea cafes"],
    "butcher shop": ["butcher", "meat shop", "meat store"], "butcher shops": ["butchers", "meat shops", "meat stores"],
    "sweet shop": ["mithai shop", "sweet store", "confectionery", "dessert shop"], "sweet shops": ["mithai shops", "sweet stores", "confectioneries"],
    "stationery": ["stationery shop", "bookshop", "book store", "paper shop"], "stationery shop": ["stationery store", "bookshop", "book store"],
    "furniture": ["furniture shop", "furniture store", "furniture market"], "furniture shop": ["furniture store", "furniture showroom"],
    "jewelry": ["jewellery", "jeweler", "jewellery shop", "gold shop"], "jewelry shop": ["jewellery store", "jeweler shop", "gold shop"],
    "tailor": ["tailor shop", "sewing shop", "stitching", "darzi"], "tailors": ["tailor shops", "sewing shops", "stitching shops"],
    "photographer": ["photography studio", "photo studio", "photography"], "photographers": ["photography studios", "photo studios"],
    "car dealer": ["car showroom", "auto dealer", "vehicle dealer", "used car"], "car dealers": ["car showrooms", "auto dealers", "vehicle dealers"],
    "bike shop": ["motorcycle shop", "bike dealer", "motorcycle dealer"], "bike shops": ["motorcycle shops", "bike dealers"],
    "pet shop": ["pet store", "animal shop", "pet supplies"], "pet shops": ["pet stores", "animal shops"],
    "sports shop": ["sports store", "sportswear", "sports equipment"], "sports shops": ["sports stores", "sportswear shops"],
    "wedding hall": ["banquet hall", "marriage hall", "event venue", "function hall"], "wedding halls": ["banquet halls", "marriage halls", "event venues"],
}
