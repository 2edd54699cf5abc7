"""Other names of process equipment, valves and instruments: the default input table of canonical.map_values.

Fixed values, compiled from general technical vocabulary (the usual English,
German and Spanish words of piping and instrumentation drawings, and the short
forms that such drawings' legends use), not from any data. Another table of the
same columns can be handed in instead. German umlauts are written ae, oe, ue;
the forms without e are made by rule, as are plurals, abbreviations by leaving
out letters and initials of names of several words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = {
    "equipment_class": {
        "valve": "ventil, armatur, valvula",
        "tank": "lagertank, tanque, deposito",
        "vessel": "drum, behaelter, kessel, recipiente",
        "column": "tower, absorber, stripper, kolonne, columna, torre",
        "heat_exchanger": "hx, htx, waermetauscher, waermeuebertrager, intercambiador",
        "pump": "pumpe, bomba",
        "compressor": "kompressor, verdichter, compresor",
        "reactor": "reaktor",
        "agitator": "stirrer, ruehrwerk, ruehrer, agitador",
        "filter": "filtro, filtre",
        "separator": "abscheider, separador",
        "fired_heater": "furnace, ofen, horno",
        "cooling_tower": "kuehlturm, torre de refrigeracion",
        "fan_blower": "fan, ventilator, geblaese, ventilador, soplante",
        "turbine": "turbina",
        "centrifuge": "zentrifuge, centrifuga",
        "dryer": "drier, trockner, secador",
        "weigher": "scale, waage, balanza, bascula",
        "mixer": "mischer, mezclador",
        "burner": "brenner, quemador",
        "air_cooler": "luftkuehler, aerorefrigerador",
    },
    "valve_type": {
        "gate": "schieber, compuerta",
        "globe": "globo",
        "check": "non return valve, one way, rueckschlagventil, rueckschlagklappe, retencion",
        "ball": "kugelhahn, bola",
        "butterfly": "bfly, absperrklappe, klappe, mariposa",
        "control": "regelventil, stellventil",
        "safety_relief": "safety, relief, pressure safety valve, pressure relief valve, sicherheitsventil, seguridad, alivio",
        "three_way": "dreiwege, dreiwegeventil, tres vias",
        "needle": "nadelventil, aguja",
        "plug": "kuekenhahn, macho",
        "strainer": "schmutzfaenger, sieb, colador",
        "rupture_disc": "bursting disc, berstscheibe, disco de ruptura",
    },
    "instrument_function": {
        "indicator": "gauge, anzeiger, indicador",
        "transmitter": "xmtr, messumformer, transmisor",
        "controller": "regler, controlador",
        "recorder": "schreiber, registrador",
        "element": "sensor, messfuehler, elemento",
        "switch": "schalter, interruptor",
        "alarm": "annunciator, alarma",
        "valve_actuator": "positioner, stellantrieb, actuador",
    },
}


def default_names(spark: SparkSession) -> DataFrame:
    """field_name, canonical, name: one row per other name."""
    rows = [(f, c, n.strip()) for f, held in NAMES.items() for c, names in held.items() for n in names.split(",")]
    return spark.createDataFrame(rows, "field_name string, canonical string, name string")
