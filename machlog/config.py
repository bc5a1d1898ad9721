"""Fixed values the results depend on (defaults of operator parameters).

These equal the values the original analytics used; they are stated here as
plain data in their natural order.
"""

# --- fixed values: sensors, thresholds, constants -------------------------

# A7/A9 pivot sensors: spindle load, spindle consumption, axis X/Y/Z/5/8
# utilisation, spindle rpm, rapid feed, contour feed, axis X/Y/Z moving,
# axis X/Y/Z in position.
A7_SENSORS = [544, 630, 537, 498, 620, 565, 584, 550, 587, 606, 601, 501, 458, 619, 609, 614]
A8_LOAD_MIN = 3

SCORE_THRESHOLD_FINAL = 4
THREE_STATE_T1 = 17
THREE_STATE_T2 = 24
FOUR_STATE_LOW = 14
FOUR_STATE_INTERMEDIATE = 20
SMOOTH_ROWS = 15

STOP_GAP_MINUTES = 5
ENERGY_GAP_CAP_S = 3600
RATED_POWER_KW = 15.0
ON_THRESHOLD = 0.0
ENERGY_VAR_FINAL = 260
ENERGY_VAR_OLD = 630
ENERGY_VAR_NAME = "MANDRINO_CONSUMO_VISUALIZADO"
ALARM_VAR = 447
FILE_STATUS_VAR = 557
PROGRAM_VARS = [828, 575]

# B1 keywords (case-insensitive contains)
B1_KEYWORDS = ["error", "stop", "fail", "fault", "imposible", "BROCA", "PLC"]

# Alarm array patterns
B8_PATTERN = r'\["?(PLC\d+)"?\s*,\s*"([^"]+)"'
B9_PATTERN = r'\["([^"]+)","([^"]+)"'
B10_PATTERN = r'\["([^"]+)","([^"]+)",([0-9]+),([0-9]+),([0-9]+)\]'

# B11 noise codes
NOISE_CODES = ["PLC00054", "PLC00010", "PLC01005", "PLC00499", "PLC00051", "PLC00050",
               "PLC00474", "PLC00475", "2a8-0003", "130-019c", "PLC00052", "PLC00761"]

# B14 detailed severity keywords
B14_CRITICAL = ["FINAL DE CARRERA", "ERROR", "ERRÓNEO", "FALLO", "FALLA", "PARADA",
                "EMERGENCIA", "COLISIÓN", "SOBRECARGA", "DEFECTO", "STOP", "FAIL",
                "FATAL", "LIMIT", "EMERGENCY", "ALARM", "SYS FAIL", "AXIS DRIVE"]
B14_WARNING = ["NO SE ENCUENTRA", "NO ENCONTRADO", "INCORRECTO", "RETIRAR", "ATENCIÓN",
               "AVISO", "BAJO", "ALTO", "TEMPERATURA", "MANTENIMIENTO", "BATERÍA",
               "DESCONOCIDO", "IMPOSIBLE", "DENEGADO", "WARNING", "WARN", "LOW", "HIGH",
               "TEMP", "MAINT", "MISSING", "NOT FOUND"]

# B15 simple severity keywords
B15_CRITICAL = ["ERR", "CRIT", "STOP", "EMERGENCY", "FAIL", "FATAL"]
B15_WARNING = ["WARN", "WRN", "LOW", "HIGH", "TEMP", "MAINT"]

# B16 alarm catalogue: code, severity, category, description
ALARM_CATALOGUE = [
    ("PLC00501", "CRITICAL", "SAFETY", "External Emergency Stop"),
    ("230-0005", "CRITICAL", "SAFETY", "External Emergency Stop (Remote)"),
    ("PLC01004", "CRITICAL", "SAFETY", "Machine Emergency Button Pressed"),
    ("230-00fd", "CRITICAL", "AXIS", "Limit Switch Hit (Axis Over-travel)"),
    ("PLC00532", "CRITICAL", "ATC", "Tool Magazine Misalignment"),
    ("PLC00853", "CRITICAL", "ATC", "ATC Interruption Error"),
    ("PLC00010", "WARNING", "DOOR", "Door Open"),
    ("PLC01005", "WARNING", "DOOR", "Enclosure Door Open"),
    ("PLC00739", "WARNING", "DOOR", "Enclosure Open in Mode 3"),
    ("PLC00474", "WARNING", "OPS", "Handwheel Required (Door Open)"),
    ("PLC00661", "WARNING", "FLUIDS", "Oil Recovery Tank Full"),
    ("PLC00491", "WARNING", "MAINT", "Rotary Joint Lubrication Required"),
    ("PLC00655", "WARNING", "MAINT", "Retighten Tool Clamping Collets"),
    ("130-009e", "WARNING", "SYSTEM", "File Access Impossible"),
    ("240-07d2", "WARNING", "SYSTEM", "Incorrect File Type"),
    ("PLC00054", "INFO", "OPS", "Feedrate Override at 0%"),
    ("PLC00499", "INFO", "OPS", "Feed Hold Active"),
    ("PLC00051", "INFO", "OPS", "M01 Conditional Stop"),
    ("PLC00050", "INFO", "OPS", "M00 Program Stop"),
    ("320-0064", "INFO", "SYSTEM", "Strobe T Interrupted"),
    ("130-019c", "INFO", "SYSTEM", "Service Files Saved"),
]
UNKNOWN_ALARM = ("WARNING", "UNKNOWN", "Unknown Alarm Code")

# B22 alert classes (English), first match wins
B22_CLASSES = [
    ("overheat|temp", "THERMAL"),
    ("power|voltage", "POWER"),
    ("door|safety", "SAFETY"),
    ("axis|encoder", "MOTION"),
    ("spindle", "SPINDLE"),
]
# B23 alert classes (multilingual), first match wins
B23_CLASSES = [
    ("(overheat|surchauff|temperat|sobrecalent)", "THERMAL"),
    ("(power|voltage|tension|voltaje|energia|corriente)", "POWER"),
    ("(door|guard|safety|seguridad|porta|puerta|interlock)", "SAFETY"),
    ("(stop|stopped|parada|arresto|emergency|e-stop|emergencia)", "STOP"),
    ("(error|fault|fail|alarm|alarma|allarme|anomalia)", "GENERIC_ALARM"),
]
MESSAGE_VARS = ["ALARMS", "EASY_LOG_MESSAGE"]
# B24 location patterns (case-sensitive)
B24_NAME_PATTERNS = [r"ZONE[_ ]?([0-9]+)", r"CONVEYOR[_ ]?([0-9]+)",
                     r"SPINDLE[_ ]?([0-9]+)", r"AXIS[_ ]?([A-Z0-9]+)"]
B24_MSG_PATTERNS = [r"(?:ZONE|ZONA)[ _-]?([0-9]+)", r"(?:CONVEYOR|TRANSPORTADOR)[ _-]?([0-9]+)",
                    r"(?:SPINDLE|MANDRINO|HUSILLO)[ _-]?([0-9]+)", r"(?:AXIS|EJE)[ _-]?([A-Z0-9]+)"]
ALERT_VAR_NAME = "(ALARM|ALERT|FAULT|ERROR)"
TOP_N_DAYS = 30

# E1 / E2 name patterns
E1_PATTERNS = ["%energy%", "%power%", "%consum%", "%electric%", "%kw%", "%kwh%", "%watt%"]
E2_PATTERNS = ["%MANDRINO%", "%POWER%", "%ENERGY%", "%CONSUM%"]

# K tag lists (upper case)
K1_TAGS_BASE = ["RUN", "ACTIVE", "AUTO", "PRODUCTION", "WORKING"]
K1_TAGS_SIX = K1_TAGS_BASE + ["HIGH ACTIVITY", "LOW ACTIVITY"]
K1_TAGS_FULL = K1_TAGS_SIX + ["INTERMEDIATE ACTIVITY"]
K2_CORE_STATES = ["High Activity", "Intermediate Activity", "Low Activity", "True Idle (Off)"]
K5_EXCLUDED = ["PRODUCTION", "ALARM", "ALARME"]
K5_ORDER = ["High Activity", "Intermediate Activity", "Low Activity", "True Idle (Off)",
            "Idle", "STANDBY", "OFF"]

ELECTRICITY_PRICE = 0.15
HOURLY_RATE = 65.0
SHIFT_HOURS = 8.0
BANDS = {"oee": (80, 60), "availability": (85, 70), "performance": (90, 75), "quality": (95, 90)}

# Driver column names the services drop from responses
I6_DROP = ["machine_id", "machine_name", "device_id", "equipment_id"]
# I8 column synonyms
I8_SYNONYMS = {
    "etat": "state", "status": "state", "m_state": "state",
    "hours": "total_hours", "duree": "total_hours", "duration": "total_hours",
    "kwh": "total_energy_kwh", "energy": "total_energy_kwh", "total_kwh": "total_energy_kwh",
    "code": "alarm_code", "alarm": "alarm_code",
    "timestamp": "date", "start_time": "date", "time": "date", "last_seen": "date",
    "jour": "date", "day": "date",
    "desc": "description", "message": "description", "alarm_text": "description",
}
