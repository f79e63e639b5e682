"""Column names and rules of the studied site.

Fixed values: the names, bounds, groups and limits below are those used, and must equal those of the
source files.
"""

PROFILER_NAMES = {
    "RECORD": "Pfl - Record number",
    "PFL_Counter": "Pfl - Day",
    "CntRS232": "Pfl - CntRS232",
    "RS232Dpt": "Pfl - Vertical position1 (m)",
    "sensorParms(1)": "Pfl - Water temperature (°C)",
    "sensorParms(2)": "Pfl - Cond (microS_cm)",
    "sensorParms(3)": "Pfl - Sp Cond (microS_cm)",
    "sensorParms(4)": "Pfl - Salinity (ppt)",
    "sensorParms(5)": "Pfl - pH",
    "sensorParms(6)": "Pfl - DO (% Sat)",
    "sensorParms(7)": "Pfl - Turbidity (NTU)",
    "sensorParms(8)": "Pfl - Turbidity (FNU)",
    "sensorParms(9)": "Pfl - Vertical position (m)",
    "sensorParms(10)": "Pfl - fDOM (RFU)",
    "sensorParms(11)": "Pfl - fDOM (QSU)",
    "lat": "Latitude",
    "lon": "Longitude",
}

# (lowest, highest) value kept; None leaves a side open.
PROFILER_BOUNDS = {
    "Pfl - Water temperature (°C)": (1, 25),
    "Pfl - Cond (microS_cm)": (0, 45),
    "Pfl - Sp Cond (microS_cm)": (1, None),
    "Pfl - Salinity (ppt)": (0, 0.03),
    "Pfl - pH": (2, 12),
    "Pfl - DO (% Sat)": (10, 120),
    "Pfl - Turbidity (NTU)": (0, None),
    "Pfl - Turbidity (FNU)": (0, None),
    "Pfl - fDOM (RFU)": (0, 100),
    "Pfl - fDOM (QSU)": (0, 300),
}

PROFILER_SENSORS = [
    "Pfl - Water temperature (°C)",
    "Pfl - Sp Cond (microS_cm)",
    "Pfl - pH",
    "Pfl - DO (% Sat)",
    "Pfl - Turbidity (FNU)",
    "Pfl - fDOM (RFU)",
    "Pfl - fDOM (QSU)",
]

WEATHER_NAMES = {
    "1818_time: DX_l[°]": "Hourly average wind direction (°)",
    "1818_time: FF Hastighet[m/s]": "Average wind speed (m/s)",
    "1818_time: FG_l[m/s]": "Maximum 3s wind gust (m/s)",
    "1818_time: PR Trykk redusert til havnivå[mBar]": "Atmospheric pressure (mBar)",
    "1818_time: QLI Langbølget[W/m2]": "Longwave (IR) radiation (W/m2)",
    "1818_time: QSI Kortbølget[W/m2]": "Shortwave (solar) radiation (W/m2)",
    "1818_time: RR_1[mm]": "Precipitation (mm/hr)",
    "1818_time: TA Middel[°C]": "Air temperature (°C)",
    "1818_time: UU Luftfuktighet[%RH]": "Humidity (%)",
}

WEATHER_TIME_RANGE = ("2000-01-01", "2099-12-31")

WEATHER_BOUNDS = {
    "Hourly average wind direction (°)": (0, 360),
    "Average wind speed (m/s)": (0, 100),
    "Maximum 3s wind gust (m/s)": (0, 100),
    "Atmospheric pressure (mBar)": (860, 1080),
    "Longwave (IR) radiation (W/m2)": (0, 750),
    "Shortwave (solar) radiation (W/m2)": (0, 900),
    "Precipitation (mm/hr)": (0, 50),
    "Humidity (%)": (0, 100),
}

WEATHER_COLUMNS = [
    "Wind speed, x (m/s)",
    "Wind speed, y (m/s)",
    "Maximum 3s wind gust (m/s)",
    "Atmospheric pressure (mBar)",
    "Longwave (IR) radiation (W/m2)",
    "Shortwave (solar) radiation (W/m2)",
    "24hr precipitation total (mm)",
    "Air temperature (°C)",
    "Humidity (%)",
]

SCADA_COLUMNS = ["SCADA - pH", "SCADA - Temperature (°C)"]

LAB_PHYSICAL = ["01-Farge", "04-Turbiditet"]
LAB_BIOLOGICAL = [
    "06-E.coli",
    "07-Intestinale enterokokker",
    "08-Kimtall 22°C",
    "09-Koliforme bakterier 37°C",
]
LAB_METALS = [
    "21-Arsen",
    "24-Bly",
    "32-Kadmium",
    "36-Kopper filtrert",
    "37-Krom",
    "41-Nikkel",
    "Sink (Zn)",
]
LAB_COLUMNS = LAB_PHYSICAL + LAB_BIOLOGICAL + LAB_METALS

COLUMN_GROUPS = {
    "profiler": PROFILER_SENSORS,
    "weather": WEATHER_COLUMNS,
    "scada": SCADA_COLUMNS,
    "lab_physical": LAB_PHYSICAL,
    "lab_biological": LAB_BIOLOGICAL,
    "lab_metals": LAB_METALS,
}

# Sources in order of priority, with the window of the linear baseline in hours.
SOURCE_CATALOGUE = [
    ("lab", LAB_COLUMNS, 550),
    ("scada", SCADA_COLUMNS, 3),
    ("profiler", PROFILER_SENSORS, 3),
    ("weather", WEATHER_COLUMNS, 3),
]
