"""They must stay exactly as written for results to be right."""

# --- Text pipeline -------------------------------------------------------
# Every character that Python's str.strip() and regex \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java regex character class.
WS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# One character each: the blank line that "\r\n" leaves behind is dropped later.
LINE_BREAK = r"[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"

# Words before a page number, in any case, as the inside of a group.
PAGE_MARK = r"p[áa]gina|page|pág\.?"

PART_CHARS = 3800
MAX_PAGES = 1000
SAMPLE_PAGES = 20
TOP_MARGIN = 0.06
BOTTOM_MARGIN = 0.94
SIZE_TOLERANCE = 0.6
PREVIEW_PAGES = 5
PREVIEW_CLEAN_PAGES = 2
PREVIEW_PAGE_CHARS = 300
PREVIEW_CLEAN_CHARS = 500
SLUG_CHARS = 80
DEFAULT_SLUG = "libro"
DEFAULT_TITLE = "Libro sin título"
MAX_UPLOAD_BYTES = 10 * 1024 * 1024

# --- Catalog -------------------------------------------------------------
UPLOAD_AUTHOR = "Documento PDF"
DEFAULT_COVER = "https://images.unsplash.com/photo-1481627834876-b7833e8f5570?w=300&h=400&fit=crop"
DEFAULT_VOICE = "es-MX-JorgeNeural"
MINUTES_PER_PART = 4
DEFAULT_DURATION = "~15min"
DEFAULT_TOTAL_SECONDS = 900

ALL_CATEGORIES = "Todas"
NEW_CATEGORY = "Nuevos"
NO_CATEGORY = "Sin Clasificar"
CATEGORIES = [
    "Todas",
    "Sin Clasificar",
    "Ficción",
    "Novela",
    "Ciencia Ficción",
    "Fantasía",
    "Romance",
    "Thriller / Suspense",
    "Terror",
    "Aventura",
    "Cuentos y Relatos",
    "Poesía",
    "Teatro / Drama",
    "No Ficción",
    "Biografía / Memorias",
    "Historia",
    "Filosofía",
    "Psicología",
    "Autoayuda / Desarrollo",
    "Ciencia y Tecnología",
    "Negocios y Economía",
    "Política y Sociedad",
    "Religión y Espiritualidad",
    "Salud y Bienestar",
    "Deportes y Hobbies",
    "Texto Académico",
    "Infantil",
    "Juvenil (YA)",
    "Comedia / Humor",
    "Ensayos",
    "Viajes",
    "Arte y Diseño",
    "Cocina y Gastronomía",
    "Otro",
]

VOICES = {
    "es-MX-JorgeNeural": "🇲🇽 Jorge (México) - Hombre",
    "es-MX-DaliaNeural": "🇲🇽 Dalia (México) - Mujer",
    "es-ES-AlvaroNeural": "🇪🇸 Álvaro (España) - Hombre",
    "es-ES-ElviraNeural": "🇪🇸 Elvira (España) - Mujer",
    "es-US-AlonsoNeural": "🇺🇸 Alonso (EEUU) - Hombre",
    "es-US-PalomaNeural": "🇺🇸 Paloma (EEUU) - Mujer",
    "es-AR-TomasNeural": "🇦🇷 Tomás (Argentina) - Hombre",
    "es-AR-ElenaNeural": "🇦🇷 Elena (Argentina) - Mujer",
    "es-BO-MarceloNeural": "🇧🇴 Marcelo (Bolivia) - Hombre",
    "es-BO-SofiaNeural": "🇧🇴 Sofía (Bolivia) - Mujer",
    "es-CL-LorenzoNeural": "🇨🇱 Lorenzo (Chile) - Hombre",
    "es-CL-CatalinaNeural": "🇨🇱 Catalina (Chile) - Mujer",
    "es-CO-GonzaloNeural": "🇨🇴 Gonzalo (Colombia) - Hombre",
    "es-CO-SalomeNeural": "🇨🇴 Salomé (Colombia) - Mujer",
    "es-EC-LuisNeural": "🇪🇨 Luis (Ecuador) - Hombre",
    "es-EC-AndreaNeural": "🇪🇨 Andrea (Ecuador) - Mujer",
    "es-PE-AlexNeural": "🇵🇪 Alex (Perú) - Hombre",
    "es-PE-CamilaNeural": "🇵🇪 Camila (Perú) - Mujer",
    "es-PY-MarioNeural": "🇵🇾 Mario (Paraguay) - Hombre",
    "es-PY-TaniaNeural": "🇵🇾 Tania (Paraguay) - Mujer",
    "es-UY-MateoNeural": "🇺🇾 Mateo (Uruguay) - Hombre",
    "es-UY-ValentinaNeural": "🇺🇾 Valentina (Uruguay) - Mujer",
    "es-VE-SebastianNeural": "🇻🇪 Sebastián (Venezuela) - Hombre",
    "es-VE-PaolaNeural": "🇻🇪 Paola (Venezuela) - Mujer",
    "es-CR-JuanNeural": "🇨🇷 Juan (Costa Rica) - Hombre",
    "es-CR-MariaNeural": "🇨🇷 María (Costa Rica) - Mujer",
    "es-CU-ManuelNeural": "🇨🇺 Manuel (Cuba) - Hombre",
    "es-CU-BelkysNeural": "🇨🇺 Belkys (Cuba) - Mujer",
    "es-DO-EmilioNeural": "🇩🇴 Emilio (R. Dominicana) - Hombre",
    "es-DO-RamonaNeural": "🇩🇴 Ramona (R. Dominicana) - Mujer",
    "es-GT-AndresNeural": "🇬🇹 Andrés (Guatemala) - Hombre",
    "es-GT-MartaNeural": "🇬🇹 Marta (Guatemala) - Mujer",
    "es-HN-CarlosNeural": "🇭🇳 Carlos (Honduras) - Hombre",
    "es-HN-KarlaNeural": "🇭🇳 Karla (Honduras) - Mujer",
    "es-NI-FedericoNeural": "🇳🇮 Federico (Nicaragua) - Hombre",
    "es-NI-YolandaNeural": "🇳🇮 Yolanda (Nicaragua) - Mujer",
    "es-PA-RobertoNeural": "🇵🇦 Roberto (Panamá) - Hombre",
    "es-PA-MargaritaNeural": "🇵🇦 Margarita (Panamá) - Mujer",
    "es-PR-VictorNeural": "🇵🇷 Víctor (Puerto Rico) - Hombre",
    "es-PR-KarinaNeural": "🇵🇷 Karina (Puerto Rico) - Mujer",
    "es-SV-RodrigoNeural": "🇸🇻 Rodrigo (El Salvador) - Hombre",
    "es-SV-LorenaNeural": "🇸🇻 Lorena (El Salvador) - Mujer",
}

# --- Playback ------------------------------------------------------------
PART_SECONDS = 240.0
SEEK_SECONDS = 15.0
SAVE_GAP_MS = 3000

# --- Clinic --------------------------------------------------------------
TEST_CATEGORY_LABELS = {
    "cognitive": "Cognitivo",
    "personality": "Personalidad",
    "mood": "Estado de Ánimo",
    "anxiety": "Ansiedad",
    "trauma": "Trauma",
}
SEVERITY_LABELS = {
    "minimal": "Mínimo",
    "mild": "Leve",
    "moderate": "Moderado",
    "severe": "Grave",
}
PATIENT_STATUS_LABELS = {
    "active": "Activo",
    "inactive": "Inactivo",
    "completed": "Completado",
}
APPOINTMENT_TYPE_LABELS = {
    "initial": "Primera consulta",
    "followup": "Seguimiento",
    "assessment": "Evaluación",
}
EVIDENCE_LABEL = "Evidencia"
REASONING_LABEL = "Razonamiento"
HIGH_OVERLAP = 70
MEDIUM_OVERLAP = 50
PROFILE_FULL_MARK = 100
MONTHS_ES = [
    "enero",
    "febrero",
    "marzo",
    "abril",
    "mayo",
    "junio",
    "julio",
    "agosto",
    "septiembre",
    "octubre",
    "noviembre",
    "diciembre",
]
