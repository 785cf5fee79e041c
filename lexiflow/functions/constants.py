"""Limits, weights and word lists that results depend on."""

TOP_K = 5
COMPLETION_RATIO = 5
SHORT_WORD, SHORT_DISTANCE, LONG_DISTANCE = 4, 1, 2
MIN_DOUBLE_LETTER, MIN_COMPLETION = 4, 3
MARGIN_ONE, MARGIN_TWO, MAX_DISTANCE, MIN_TWO_MISTAKES, CONTEXT_CANDIDATES = 2.0, 4.0, 2, 6, 20
SLIP_WEIGHTS = (50.0, 20.0, 20.0, 10.0, 1.0)
CONTEXT_WEIGHT, POPULARITY_WEIGHT = 0.7, 0.3
REQUIRED_RATIO, MAX_SIDE_RATIO, PAIR_WEIGHT = 8.0, 50.0, 0.9
MIN_LEARN_WEIGHT, LEARN_DIVISOR, SAVE_EVERY = 25, 1000, 10
USER_WORD_FREQ = 100
MIN_PREFIX = 2
IDLE_SECONDS = 2.5
MAX_REPLACEMENT, DIAGNOSTICS_BYTES, TEXT_WAIT_MS = 100, 256 * 1024, 150
MAX_LINE_HEIGHT, FIELD_MARGIN = 400, 40
MAX_WORDS, LISTED_COUNT, TOP_COUNT, MAX_WORD_LENGTH = 100_000, 30, 200_000, 20
MISSPELLING_MAX_COUNT, MISSPELLING_RATIO, MISSPELLING_MIN_LENGTH = 25, 50, 5
MIN_COUNT_THREE_LETTERS = 10

CONFUSION_SETS = [
    ("from", "form"), ("than", "then"), ("of", "off"), ("to", "too"), ("lose", "loose"), ("quite", "quiet"),
    ("whether", "weather"), ("buy", "by"), ("there", "their"), ("accept", "except"), ("affect", "effect"),
    ("advice", "advise"), ("breath", "breathe"), ("past", "passed"), ("here", "hear"), ("know", "now"), ("were", "where"),
]

SENSITIVE_TERMS = [
    "password", "passcode", "passphrase", "sign in", "signin", "sign-in", "log in", "login", "log-in", "credential",
    "authentication", "authenticator", "two factor", "2fa", "bitlocker", "keychain", "1password", "bitwarden", "lastpass",
    "keepass", "dashlane", "private browsing", "incognito", "seed phrase", "recovery phrase",
]

CODE_PROCESSES = [
    "antigravity ide", "code", "code - insiders", "codium", "vscodium", "cursor", "windsurf", "zed", "devenv", "rider64",
    "idea64", "pycharm64", "webstorm64", "clion64", "goland64", "phpstorm64", "studio64", "sublime_text", "notepad++", "vim",
    "gvim", "nvim", "emacs", "windowsterminal", "openconsole", "conhost", "cmd", "powershell", "pwsh", "mintty", "alacritty",
    "wezterm-gui", "putty", "kitty", "hyper", "tabby",
]

TEXT_CLASSES = ["edit", "richedit", "textbox", "scintilla", "textinput"]
UNKNOWABLE_CLASSES = ["chrome_renderwidgethosthwnd", "chrome_widgetwin", "mozillawindowclass", "windows.ui.core.corewindow"]
NON_TEXT_CLASSES = [
    "syslistview32", "systreeview32", "systabcontrol32", "sysheader32", "button", "listbox", "combobox", "scrollbar", "static",
    "directuihwnd", "progman", "workerw", "shell_traywnd", "shelldll_defview", "mstaskswwclass",
]

ONE_LETTER = ["a", "i"]
TWO_LETTER = [
    "am", "an", "as", "at", "ax", "be", "by", "do", "go", "ha", "he", "hi", "id", "if", "in", "is", "it", "lo", "ma", "me",
    "my", "no", "of", "oh", "ok", "on", "or", "ox", "pa", "so", "to", "up", "us", "we", "ye", "cd", "dr", "mr", "ms", "pm",
    "st", "tv", "uk",
]
BROKEN_CONTRACTIONS = [
    "im", "ive", "youre", "youve", "youll", "hes", "shes", "weve", "theyre", "theyve", "theyll", "thats", "whats", "wheres",
    "whos", "dont", "doesnt", "didnt", "cant", "couldnt", "wouldnt", "shouldnt", "isnt", "arent", "wasnt", "werent", "hasnt",
    "havent", "hadnt", "wont", "aint", "heres", "theres", "youd", "theyd", "hed", "itd", "isn", "doesn", "didn", "wasn",
    "weren", "couldn", "wouldn", "shouldn", "hasn", "hadn", "aren", "shan", "mustn", "needn", "mightn", "oughtn",
]
DIALECT = ["dat", "dem", "dey", "dis", "nuff", "yer", "wuz", "afore"]
EVERYDAY_SHORT = [
    "jog", "oar", "sob", "wag", "woe", "wok", "hoe", "pry", "sly", "elm", "eel", "ewe", "fig", "fir", "hue", "ivy", "keg",
    "lark", "moss", "nib", "oat", "pod", "pug", "ram", "rye", "sap", "sow", "tad", "vat", "yak",
]
MODERN = [
    "website", "websites", "webpage", "webpages", "username", "usernames", "login", "logout", "signup", "online", "offline",
    "email", "emails", "blog", "blogs", "blogger", "podcast", "podcasts", "laptop", "laptops", "smartphone", "smartphones",
    "app", "apps", "wifi", "browser", "browsers", "url", "urls", "pdf", "jpeg", "png", "html", "css", "javascript", "dataset",
    "datasets", "database", "databases", "filename", "filenames", "checkbox", "dropdown", "hashtag", "hashtags", "emoji",
    "selfie", "google", "youtube", "facebook", "twitter", "whatsapp", "instagram", "linkedin", "github", "wikipedia",
    "android", "iphone", "windows", "microsoft", "netflix", "spotify", "chatbot", "internet", "intranet", "cybersecurity",
    "malware", "firewall", "backup", "backups",
]
INFORMAL = {
    "wassup": 60, "sup": 90, "hiya": 60, "yep": 320, "yup": 180, "nah": 320, "hmm": 200, "huh": 180, "ugh": 90, "yay": 110,
    "oops": 150, "bruh": 90, "bro": 500, "bros": 80, "fam": 60, "lol": 420, "lmao": 140, "rofl": 40, "omg": 260, "btw": 320,
    "fyi": 300, "idk": 140, "imo": 110, "imho": 40, "tbh": 110, "ikr": 40, "brb": 80, "pls": 160, "plz": 80, "thx": 90,
    "wtf": 190, "y'all": 190, "kinda": 300, "sorta": 110, "lemme": 90, "outta": 90, "cuz": 90, "coz": 50, "innit": 30,
    "selfie": 150, "selfies": 70, "emoji": 230, "emojis": 90, "meme": 260, "memes": 170, "vlog": 50, "vlogger": 20,
    "screenshot": 430, "screenshots": 180, "hashtag": 140, "hashtags": 60, "livestream": 60, "unfollow": 30, "retweet": 50,
    "repost": 40, "podcasts": 120, "chatbot": 180, "chatbots": 80, "unsubscribe": 80, "legit": 110, "vibe": 110, "vibes": 90,
    "cringe": 60, "sus": 40, "noob": 50,
}
UNWANTED = ["milf", "milfs", "viagra", "cialis", "levitra", "hentai"]
