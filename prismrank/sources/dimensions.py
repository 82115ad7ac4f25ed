"""Dimension tables of sensors and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Bands of the two sensors' products, in order of position.
BANDS_13 = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12")
BANDS_12 = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")

# Spectral group of each band, and metres per pixel.
SPECTRAL_GROUP = {
    "B01": "Coastal/Aerosol", "B02": "Visible (RGB)", "B03": "Visible (RGB)", "B04": "Visible (RGB)", "B05": "Red-Edge", "B06": "Red-Edge", "B07": "Red-Edge",
    "B08": "NIR", "B8A": "NIR", "B09": "Water Vapor", "B10": "Cirrus/SWIR", "B11": "Cirrus/SWIR", "B12": "Cirrus/SWIR",
}
RESOLUTION = {"B01": 60, "B02": 10, "B03": 10, "B04": 10, "B05": 20, "B06": 20, "B07": 20, "B08": 10, "B8A": 20, "B09": 60, "B10": 60, "B11": 20, "B12": 20}

# The ten single-label classes and their readable names.
SCENE_CLASSES = {
    "AnnualCrop": "annual crop land", "Forest": "forest", "HerbaceousVegetation": "herbaceous vegetation", "Highway": "highway or major road", "Industrial": "industrial area",
    "Pasture": "pasture land", "PermanentCrop": "permanent crop land", "Residential": "residential area", "River": "river", "SeaLake": "sea or lake",
}

# The ten most frequent classes of the 19-class nomenclature that
# are kept, and their readable names.
COVER_CLASSES = {
    "Broad-leaved forest": "broad-leaved forest",
    "Coniferous forest": "coniferous forest",
    "Mixed forest": "mixed forest",
    "Arable land": "arable land for agriculture",
    "Pastures": "pasture land",
    "Complex cultivation patterns": "complex cultivation patterns",
    "Land principally occupied by agriculture, with significant areas of natural vegetation": "agricultural land with natural vegetation",
    "Natural grassland and sparsely vegetated areas": "natural grassland and sparse vegetation",
    "Transitional woodland/shrub": "transitional woodland and shrubs",
    "Urban fabric": "urban residential area",
}

# Level-3 land-cover names that have another name among the 19
# classes; a name that is not here is its own class.
LAND_COVER_19 = {
    "Continuous urban fabric": "Urban fabric",
    "Discontinuous urban fabric": "Urban fabric",
    "Green urban areas": "Urban fabric",
    "Sport and leisure facilities": "Urban fabric",
    "Airports": "Industrial or commercial units",
    "Port areas": "Industrial or commercial units",
    "Road and rail networks and associated land": "Industrial or commercial units",
    "Mineral extraction sites": "Industrial or commercial units",
    "Dump sites": "Industrial or commercial units",
    "Construction sites": "Industrial or commercial units",
    "Non-irrigated arable land": "Arable land",
    "Permanently irrigated land": "Arable land",
    "Rice fields": "Arable land",
    "Vineyards": "Permanent crops",
    "Fruit trees and berry plantations": "Permanent crops",
    "Olive groves": "Permanent crops",
    "Annual crops associated with permanent crops": "Complex cultivation patterns",
    "Natural grasslands": "Natural grassland and sparsely vegetated areas",
    "Sparsely vegetated areas": "Natural grassland and sparsely vegetated areas",
    "Burnt areas": "Natural grassland and sparsely vegetated areas",
    "Bare rocks": "Natural grassland and sparsely vegetated areas",
    "Moors and heathland": "Moors, heathland and sclerophyllous vegetation",
    "Sclerophyllous vegetation": "Moors, heathland and sclerophyllous vegetation",
    "Transitional woodland-shrub": "Transitional woodland/shrub",
    # the same class as other releases of the metadata spell it
    "Transitional woodland, shrub": "Transitional woodland/shrub",
    "Glaciers and perpetual snow": "Beaches, dunes, sands",
    "Inland marshes": "Inland wetlands",
    "Peat bogs": "Inland wetlands",
    "Salt marshes": "Coastal wetlands",
    "Salines": "Coastal wetlands",
    "Intertidal flats": "Coastal wetlands",
    "Water courses": "Inland waters",
    "Water bodies": "Inland waters",
    "Coastal lagoons": "Marine waters",
    "Estuaries": "Marine waters",
    "Sea and ocean": "Marine waters",
}


def band_names(count: int) -> tuple[str, ...]:
    """Names by position; a product of 12 bands has no B10."""
    if count not in (12, 13):
        raise ValueError(f"no sensor product has {count} bands")
    return BANDS_13 if count == 13 else BANDS_12


def band_table(spark: SparkSession, count: int) -> DataFrame:
    """band_pos, band, spectral_group, resolution."""
    return spark.createDataFrame([(i, b, SPECTRAL_GROUP[b], RESOLUTION[b]) for i, b in enumerate(band_names(count))], "band_pos int, band string, spectral_group string, resolution int")


def band_index(name: str, count: int = 13) -> int:
    """S13; an unknown name is an error."""
    names = band_names(count)
    if name not in names:
        raise KeyError(f"unknown band {name!r}; there are {', '.join(names)}")
    return names.index(name)


def rgb_positions(count: int = 13) -> tuple[int, int, int]:
    """Positions of red, green, blue."""
    return tuple(band_index(b, count) for b in ("B04", "B03", "B02"))


def class_table(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """class_id, class_name, readable."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(names.items())], "class_id int, class_name string, readable string")
