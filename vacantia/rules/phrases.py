"""Phrases that tell what a contact is for, as they read after folding accents and case."""

from __future__ import annotations

# Phrases by the purpose they state outright.
STATED = {
    "business_partnership": (
        "propozycje wspolpracy", "oferty wspolpracy", "nawiaz wspolprace", "zapraszamy do wspolpracy", "kontakt dla partnerow", "partnerzy biznesowi", "zostan partnerem", "wspolpraca b2b", "propozycje biznesowe",
        "business enquiries", "business inquiries", "business proposals", "partnership enquiries", "partnership inquiries", "partnership proposals", "business development enquiries", "business development inquiries",
    ),
    "sales": ("oferty handlowe", "kontakt handlowy", "dzial handlowy", "commercial offers", "sales enquiries", "sales inquiries"),
    "supplier": ("dla dostawcow", "zostan dostawca", "wspolpraca z dostawcami", "supplier enquiries", "supplier inquiries", "vendor enquiries", "vendor inquiries"),
}
# Phrases of pages for firms, and those pages' paths.
FOR_FIRMS = ("kontakt dla firm", "wspolpraca z biznesem")
PATHS_FOR_FIRMS = ("kontakt-dla-firm", "wspolpraca-z-biznesem")
# Consents to commercial information.
CONSENT = (
    "zgadzam sie na otrzymywanie informacji handlowych", "zgoda na otrzymywanie informacji handlowych", "wyrazam zgode na otrzymywanie informacji handlowych", "wyrazam zgode na przesylanie informacji handlowych",
    "zgoda na informacje handlowe", "consent to receive commercial information", "consent to receive marketing information",
)
# Phrases that only hint at a purpose, in order.
HINTS = (
    ("b2b", "business_partnership"), ("partnerzy", "business_partnership"), ("partner", "business_partnership"), ("partnership", "business_partnership"), ("partnerships", "business_partnership"), ("cooperation", "business_partnership"),
    ("wspolpraca", "business_partnership"), ("dla firm", "business_partnership"), ("kontakt biznesowy", "business_partnership"), ("business contact", "business_partnership"), ("business development", "business_partnership"), ("biznes", "business_partnership"),
    ("sprzedaz", "sales"), ("sales", "sales"), ("commercial", "sales"), ("zakupy", "supplier"), ("procurement", "supplier"), ("supplier", "supplier"), ("suppliers", "supplier"), ("vendor", "supplier"), ("vendors", "supplier"),
    ("franczyza", "franchise"), ("franchise enquiries", "franchise"), ("franchise inquiries", "franchise"), ("franchise", "franchise"),
)
# Phrases that forbid offers.
FORBIDDEN = (
    "nie przyjmujemy ofert handlowych", "nie przesylac ofert handlowych", "nie wysylaj ofert handlowych", "zakaz przesylania ofert handlowych", "brak zgody na oferty handlowe", "no commercial offers", "do not send commercial offers", "no sales solicitations",
)
# Phrases of privacy, recruitment and support.
PRIVACY = ("rodo", "iod", "inspektor ochrony danych", "privacy", "dane osobowe", "dpo@", "data protection officer")
RECRUITMENT = ("rekrutacja", "kariera", "praca", "szukaj-pracy", "szukaj pracy", "wyszukiwarka ofert pracy", "cv", "hr@", "jobs@", "careers", "career", "recruitment", "talent acquisition")
SUPPORT = ("obsluga klienta", "reklamacje", "pomoc", "support", "serwis", "customer service", "helpdesk")
# Mailbox names by purpose.
MAILBOXES = {
    "business_partnership": ("wspolpraca", "wspolpracab2b", "partnerzy", "partner", "partners", "partnership", "partnerships", "b2b", "biznes", "business"),
    "sales": ("oferty", "ofertyhandlowe", "handel", "handlowy", "sprzedaz", "sales", "commercial"),
    "supplier": ("zakupy", "procurement", "dostawcy", "supplier", "suppliers", "vendor", "vendors"),
    "franchise": ("franczyza", "franchise"),
}
