"""Lists, patterns and orders that results depend on, stated once."""

# Hosts whose application forms need an account.
HOSTILE_DOMAINS = ("workday.com", "myworkdayjobs.com", "myworkdaysite.com", "taleo.net", "successfactors.com", "icims.com", "phenompeople.com", "smartrecruiters.com", "jobvite.com")
# Local parts of addresses that nobody reads.
NO_REPLY = ("noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "do_not_reply", "mailer-daemon", "postmaster")
# Contact patterns and their replacements.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<![\w])(?:\(?\+?\d[\d\s()./-]{5,}\d)(?![\w])"
_STREET = r"via|viale|piazza|corso|calle|carrer|street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?"
STREET_PREFIX = rf"(?i)\b(?:{_STREET})\s+[A-Za-zÀ-ÿ0-9.'’-]+(?:\s+[A-Za-zÀ-ÿ0-9.'’-]+){{0,5}},?\s+\d+[A-Za-z]?\b"
STREET_SUFFIX = r"(?i)\b\d{1,5}\s+[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'’-]*(?:\s+[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ.'’-]*){0,4}\s+(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?)\b"
STREET_NUMBER = rf"(?i)\b\d{{1,5}}[A-Za-z]?\s+(?:{_STREET})\b"
SECRET = r"(?i)(?:authorization|\bbasic\s+[A-Za-z0-9+/=]{8,}|(?:api[_ -]?key|app[_ -]?(?:id|key)|client[_ -]?(?:id|secret)|access[_ -]?token|password|secret)\s*[:=])"
JOB_ID_IN_PATH = r"(?:(?<=/)|(?<=-)|(?<=_))[0-9]{7,12}(?=$|/)"
HOST_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL_TOKEN, PHONE_TOKEN, ADDRESS_TOKEN = "[EMAIL_REDACTED]", "[PHONE_REDACTED]", "[ADDRESS_REDACTED]"
REDACTION_NOTE = " [CONTACT_REDACTION_APPLIED] no raw contact data is persisted."
DECODE_ROUNDS = 8
PLAIN_DATE = r"\d{4}-\d{2}-\d{2}"
# Marks around the data of an offer in a prompt, and its fields.
OFFER_MARKS = ("<UNTRUSTED_JOB_DATA_JSON>", "</UNTRUSTED_JOB_DATA_JSON>")
OFFER_FIELDS = ("job_key", "id", "portal", "title", "company", "location", "date", "description", "salary", "remote", "source_call", "source_ids", "duplicate_sources")
# Names of the fields of a payload.
RESULT_FIELDS = ("id", "portal", "title", "company", "location", "url", "date", "description", "remote", "salary", "source_call", "new", "source_ids", "duplicate_sources", "email_contacto", "ats_hostil")
FAILURE_FIELDS = ("call_id", "portal", "code", "message", "exit_code", "raw_file", "stderr_file", "backup_file", "expected")
COUNT_FIELDS = ("calls", "successful_calls", "failed_calls", "skipped_calls", "raw_results", "normalized_results", "deduplicated", "results", "new", "seen", "failures", "skipped")
RANK_FIELDS = ("job_key", "score", "tier", "verdict", "strengths", "gaps", "salary", "notes", "title", "company", "location", "url", "date", "remote", "portal", "source_ids", "duplicate_sources")
# Review vocabulary, best tier first.
TIERS = ("A+", "A", "B+", "B", "C", "VETO")
VERDICTS = ("APLICAR", "APLICAR SI SOBRA TIEMPO", "DESCARTAR")
# Application states and the next action of each.
NEXT_ACTIONS = {
    "draft": "Revisar y decidir si aplicar",
    "applied": "Esperar confirmación / preparar seguimiento",
    "in_progress": "Esperar próxima etapa",
    "interview": "Preparar entrevista",
    "offer": "Revisar oferta",
    "hired": "Cerrar búsqueda",
    "offer_declined": "Registrar motivo y calibrar",
    "rejected": "Registrar feedback y calibrar",
    "no_response": "Registrar cierre y calibrar",
}
FINAL_STATES = ("hired", "offer_declined", "rejected", "no_response")
FOLLOW_UP_STATES = ("applied", "in_progress", "interview")
FOLLOW_UP_DAYS, FOLLOW_UPS = 10, 2
FOLLOW_UP_NOTE, FOLLOW_UP_ACTION = "follow-up {} draft created; manual review required", "Revisar y enviar follow-up manual"
TRACKER_COLUMNS = ("fecha", "empresa", "rol", "portal", "url", "tier", "score", "estado", "próxima acción", "notas")
# Share of each dimension in a score.
WEIGHTS = {"location": 0.25, "role": 0.25, "skills": 0.20, "sector": 0.15, "pay": 0.10, "language": 0.05}
# Places of a score's tiers, as listed, and what a tier's place is worth.
PLACES = {
    "A+": ("Casalecchio di Reno", "Bologna"),
    "A": ("Nápoles", "Palermo", "Génova", "Bari", "Catania", "Venecia", "Mesina", "Trieste", "Tarento", "Reggio Calabria", "Rávena", "Livorno", "Rímini", "Cagliari", "Salerno", "Latina", "Sássari", "Pescara", "Siracusa", "Ancona", "Lecce", "La Spezia", "Pisa"),
    "B": ("Barcelona", "Valencia", "Málaga", "Palma", "Las Palmas", "Alicante", "Bilbao", "Vigo", "L'Hospitalet", "Gijón", "La Coruña", "Elche", "Badalona", "Cartagena", "Jerez", "Santa Cruz Tenerife", "Almería", "San Sebastián", "Castellón", "Santander", "Marbella", "Tarragona", "Huelva", "Mataró"),
    "C": ("Modena", "Imola", "Reggio Emilia", "Parma", "Firenze"),
    "VETO": ("Milán", "Roma", "Turín"),
}
PLACE_SCORES = {"A+": 10.0, "A": 9.0, "B+": 8.0, "B": 6.0, "C": 3.0, "VETO": 0.0}
# Wanted roles with the lowest and highest score of their band, in order of preference.
ROLE_BANDS = (
    (9.0, 10.0, ("Responsabile IT", "IT Manager", "Technology Advisor")),
    (8.0, 9.0, ("Digital Transformation Manager", "Responsabile Soluzioni Digitali", "IT/OT Specialist")),
    (7.0, 8.0, ("AI Automation Consultant", "AI Solutions Consultant", "Energy Manager", "EGE")),
    (5.0, 6.0, ("BI Manager", "Data Manager")),
)
# The sector's bonus, portals whose language is English, certificates that exclude, and remarks on a score.
SECTOR_BONUS = {"marine": 2.0, "industry": 1.0}
ENGLISH_PORTALS = ("remoteok", "wwr", "remotive")
CERTIFICATES = ("PMP", "ITIL Expert", "CISSP", "CISM")
SCORE_NOTES = {
    "language": "penalización idioma -1.5 (oferta en inglés sin requerirlo)",
    "pay": "salario no declarado — preguntar en primer contacto",
    "email": "aplicación directa por email — baja fricción",
    "hostile": "ATS hostil (Workday/Taleo/etc.) — aplicación cara en tiempo",
}
# Cells of the table of the latest postings.
PENDING, YES, NO = "pendiente", "sí", "no"
