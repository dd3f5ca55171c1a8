"""Rule packs and word lists. Results depend on them as they stand."""

# (name, priority, keywords, sender patterns, confidence threshold)
BASE_RULES = [
    ("Financial", 1,
     ["payment", "invoice", "bill", "receipt", "balance", "card", "bank", "transaction", "charge", "refund", "statement", "due", "overdue", "account", "credit", "debit", "finance", "money", "cost", "price", "subscription", "renewal", "billing", "paypal", "stripe", "affirm"],
     ["billing@", "finance@", "payments@", "noreply@.*bank", "@affirm", "statement@", "receipts@", "invoices@"], 0.7),
    ("Notifications", 2,
     ["notification", "alert", "reminder", "backup", "report", "status", "update", "confirm", "verification", "security", "warning", "error", "maintenance", "system", "server", "service", "monitoring"],
     ["noreply@", "no-reply@", "notifications@", "alerts@", "backupstatus@", "system@", "service@"], 0.7),
    ("Transportation", 3,
     ["ride", "trip", "uber", "lyft", "bird", "scooter", "taxi", "journey", "pickup", "dropoff", "driver", "vehicle", "transportation", "travel"],
     ["@uber.com", "@lyft.com", "@bird.co", "noreply@bird.co"], 0.8),
    ("Marketing/News", 4,
     ["newsletter", "unsubscribe", "marketing", "offer", "deal", "promotion", "sale", "discount", "coupon", "news", "update", "announcement", "campaign", "launch", "featured", "exclusive", "limited"],
     ["marketing@", "newsletter@", "promotions@", "news@", "@mail.beehiiv.com", "@mindstream.news", "@therundown.ai"], 0.7),
    ("Social", 5,
     ["social", "friend", "follow", "like", "comment", "mention", "tag", "share", "post", "message", "connection", "network", "community"],
     ["@facebook.com", "@twitter.com", "@linkedin.com", "@instagram.com"], 0.8),
    ("Work/Business", 6,
     ["meeting", "project", "work", "team", "deadline", "task", "calendar", "conference", "presentation", "document", "report", "business", "corporate", "office", "colleague", "manager", "client"],
     ["calendar@", "teams@", "@company.com", "@workplace"], 0.7),
]
CUSTOM_RULES = [
    ("AI_Newsletters", 2,
     ["artificial intelligence", "AI", "machine learning", "neural", "chatgpt", "openai", "claude", "anthropic", "llm", "gpt"],
     ["@therundown.ai", "@mindstream.news", "@theresanaiforthat.com", "futureblueprint@", "@product-guy.com"], 0.8),
    ("Backup_Reports", 2,
     ["backup", "backed up", "backup report", "backup status", "idrive", "backup summary", "backup notification"],
     ["@backupstatus.idrive.com", "backup@", "idrive@"], 0.9),
    ("Educational", 7,
     ["course", "lesson", "education", "learning", "tutorial", "class", "study", "academic", "university", "estacio"],
     ["@estacio.br", "@university", "@edu", "education@"], 0.8),
]
AUTOMATED_SENDERS = ["noreply", "no-reply", "notification", "alert", "service", "support", "help", "admin", "system", "donotreply", "automated", "robot", "bot", "mailer-daemon"]
AUTOMATED_SUBJECT = "^(Re:|Fwd:|AUTO:|ALERT:|NOTIFICATION:)"
AUTOMATED_DOMAINS = ["amazonaws.com", "sendgrid.", "mailgun.", "mailchimp.", "beehiiv.com"]

SENDER_PATTERNS = {
    "Newsletter": ["newsletter@", "news@", "hello@.*news", r"@mail\.", r"@newsletter\.", "mindstream", "theresanaiforthat", "rundown", "futureblueprint"],
    "Service_Notification": ["noreply@", "no-reply@", "notification@", "alerts@", r"bird\.co", "backupstatus", "netdata", r"@service\."],
    "Support": ["support@", "help@", "customer@", "service@", "care@"],
    "Marketing": ["marketing@", "promo@", "offers@", "sales@", r"@promo\.", "affirm-billing", r"@deals\."],
    "Transactional": ["billing@", "receipts@", "orders@", "payments@", "account@"],
    "Educational": ["@edu", "learning@", "training@", "courses@", "estacio"],
}
SUBJECT_PATTERNS = {
    "Support": ["^Re:", r"\[.*Support.*\]", "help", "issue", "problem"],
    "Transactional": ["receipt", "order", "payment", "invoice", "billing", "confirmation", "your account"],
    "Marketing": ["sale", "offer", "discount", "deal", "promo", "limited time", "% off", "free shipping"],
    "Newsletter": ["weekly", "daily", "roundup", "digest", "newsletter", r"update.*\d{4}", "edition"],
    "Service_Notification": ["alert", "notification", "reminder", "scheduled", "backup", "ride receipt", "trip summary"],
    "Personal": ["^Re:", "^Fwd:", "meeting", "lunch", "call"],
    "System": ["security", "login", "password", "verify", "activate"],
}
DOMAIN_KEYWORDS = {
    "AI/Technology": ["artificial intelligence", "machine learning", "chatgpt", "gpt", "neural network", "deep learning", "ai", "llm", "algorithm", "tech", "software", "api", "coding", "programming", "startup"],
    "Finance": ["bank", "credit", "loan", "investment", "stock", "crypto", "bitcoin", "financial", "money", "payment", "mastercard", "visa"],
    "Travel/Transportation": ["flight", "hotel", "travel", "trip", "vacation", "ride", "uber", "lyft", "bird", "scooter", "transport"],
    "Education": ["course", "learning", "study", "university", "college", "school", "education", "training", "certificate", "degree"],
    "Health/Fitness": ["health", "fitness", "workout", "diet", "medical", "doctor", "nutrition", "wellness", "exercise"],
    "Shopping/Retail": ["shop", "store", "buy", "purchase", "product", "cart", "amazon", "ebay", "retail", "order"],
}
PRIORITY_KEYWORDS = {
    "High": ["urgent", "important", "action required", "expires", "deadline", "security alert", "verify", "suspend", "immediate"],
    "Medium": ["reminder", "notice", "update", "changes", "attention", "review", "confirmation"],
}
AUTOMATION_INDICATORS = ["this is an automated", "do not reply", "unsubscribe", "automatically generated", "no-reply", "system message"]
SOURCE_AUTOMATED = ["noreply", "no-reply", "donotreply", "automated", "system"]

AI_KEYWORDS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "chatgpt", "openai", "anthropic", "claude", "gpt-4", "llm", "large language",
    "ai news", "ai weekly", "ai digest", "ai newsletter", "ai updates", "ml news", "ml weekly", "deep tech", "ai research", "ai breakthroughs",
    "gen ai", "generative ai", "foundation models", "transformer", "prompt engineering", "ai tools", "ai startup", "ai industry",
]
AI_DOMAINS = [
    "deeplearning.ai", "openai.com", "anthropic.com", "huggingface.co", "thesequence.substack.com", "importai.substack.com", "thebatch.ai", "aiweekly.co", "theaitimes.com",
    "artificialintelligence-news.com", "venturebeat.com", "techcrunch.com", "thenextweb.com", "newsletter.deepmind.com", "ai.googleblog.com", "research.fb.com", "distill.pub",
    "paperswithcode.com", "towards-data-science", "kdnuggets.com", "analyticsindiamag.com",
]
NEWSLETTER_PATTERNS = ["weekly.*ai", "ai.*weekly", "daily.*ai", "ai.*daily", "newsletter.*ai", "ai.*newsletter", "digest.*ai", "ai.*digest", "roundup.*ai", "ai.*roundup", "briefing.*ai", "ai.*briefing", "updates.*ai", "ai.*updates", "summary.*ai", "ai.*summary"]
UNSUBSCRIBE_PATTERNS = ["unsubscribe", "opt.?out", "manage.*subscription", "email.*preference", "update.*preference"]
NEWSLETTER_SENDERS = ["no-reply", "noreply", "automated", "newsletter", "digest"]
#: Points: subject keyword, sender keyword, known domain, newsletter pattern, unsubscribe, automated sender.
NEWSLETTER_POINTS = (3, 2, 4, 2, 1, 1)

CLI_CATEGORIES = [
    ("Financial", ["payment", "invoice", "bill", "receipt", "bank", "card"]),
    ("Notifications", ["notification", "alert", "reminder", "update"]),
    ("Marketing", ["newsletter", "unsubscribe", "offer", "deal", "sale"]),
    ("Social", ["friend", "follow", "like", "comment", "share"]),
]
SIGNATURES = ["best regards", "sincerely", "thanks", "cheers", "signature"]
ENGLISH_WORDS = ["the", "and", "you", "your", "this", "that", "with", "have"]
URL_PATTERN = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "source", "medium", "campaign", "ref", "referrer", "track", "tracking"]
PERSONAL_HOSTS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
SERVICE_WORDS = ["noreply", "mail", "email", "notify", "alerts"]
LENGTH_EDGES = [0, 500, 2000, 5000, 10000, 20000]
LENGTH_LABELS = ["Very Short", "Short", "Medium", "Long", "Very Long", "Extremely Long"]
FOUND_ADDRESS = r"[\w\.-]+@[\w\.-]+\.\w+"
VALID_ADDRESS = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Personal data, replaced in this order.
PII = [
    ("card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{16}\b", "[REDACTED_CC]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("email", r"[\w.+-]+@[\w.-]+\.\w+", "[REDACTED_EMAIL]"),
    ("phone", r"(?:\+\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    ("ip", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[REDACTED_IP]"),
]
