"""Built-in collections, and in which part of the screen a collection goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id, name, sensitivity and prompts of the built-in collections.
BUILT_IN = (
    ("builtin_pets", "Pets", 3.0, ("a photo of a pet", "a dog", "a cat", "a cute animal at home")),
    ("builtin_flowers", "Flowers", 3.0, ("a photo of flowers", "a blooming flower", "a bouquet of flowers", "a flower garden")),
    ("builtin_beach", "Beach", 3.0, ("a photo of a beach", "sand and ocean waves", "a tropical beach", "people at the seaside")),
    ("builtin_food", "Food", 3.0, ("a photo of food", "a plate of delicious food", "a meal on a table", "a restaurant dish")),
    ("builtin_documents", "Documents", 3.0, ("a photo of a document", "a page of printed text", "a receipt", "a scanned paper")),
    ("builtin_screenshots", "Screenshots", 3.0, ("a screenshot of a phone screen", "a screenshot of an app", "a chat conversation screenshot")),
    ("builtin_selfies", "Selfies", 3.0, ("a selfie", "a close-up photo of a person smiling at the camera", "a mirror selfie")),
    ("builtin_school_life", "School life", 3.0, ("students in a classroom", "children in school uniforms", "a school bag and books on a desk", "a teacher at a whiteboard", "kids at school")),
    ("builtin_friends_parties", "Friends and parties", 2.8, ("a group of friends posing together", "friends laughing at a party", "people celebrating at a party", "a group selfie with friends")),
    ("builtin_family", "Family", 2.8, ("a family photo", "a family gathered together", "parents with their children", "a family dinner at home", "grandparents with their grandchildren")),
    ("builtin_birthdays", "Birthdays", 3.0, ("a birthday cake with candles", "a birthday party with balloons", "blowing out birthday candles", "birthday decorations")),
    ("builtin_weddings_festivals", "Weddings and festivals", 3.0, ("a bride and groom at a wedding", "wedding decorations and flowers", "festival lights and oil lamps", "people in traditional festive clothes", "fireworks at a celebration")),
    ("builtin_notes_whiteboards", "Notes and whiteboards", 3.0, ("a whiteboard with writing on it", "handwritten notes on paper", "a presentation slide", "a notebook page with notes", "a blackboard with chalk writing")),
    ("builtin_tickets_passes", "Tickets and passes", 3.0, ("a boarding pass", "an event ticket", "a QR code on a ticket", "a train or bus ticket", "a booking confirmation")),
    ("builtin_memes", "Memes and forwards", 3.0, ("a meme with text over an image", "a funny picture with a caption", "a greeting image with a quote", "a good morning wish image")),
    ("builtin_mountains", "Mountains", 3.0, ("mountains", "a snowy mountain peak", "hills covered in mist", "a view from a mountain trek", "a valley between mountains")),
    ("builtin_night_sky", "Night sky", 3.0, ("the night sky full of stars", "the moon in the dark sky", "a starry sky over a landscape", "the milky way")),
    ("builtin_sports", "Sports", 3.0, ("people playing a sport", "a cricket match", "a football game", "an athlete in action", "a sports stadium")),
    ("builtin_golden_hour", "Golden hour", 2.8, ("golden hour light", "warm sunset glow", "a photo taken at golden hour", "long orange shadows at sunset")),
    ("builtin_rainy", "Rainy", 3.0, ("a rainy day", "raindrops on a window", "wet streets in the rain", "a grey rainy sky")),
    ("builtin_road_trip", "Road trip", 3.0, ("a road trip", "a view from a car window on a highway", "an open road through the countryside", "a scenic drive")),
)


def built_in(spark: SparkSession) -> DataFrame:
    """id, name, prompts, sensitivity, ord."""
    rows = [(i, name, list(prompts), sensitivity, n) for n, (i, name, sensitivity, prompts) in enumerate(BUILT_IN)]
    return spark.createDataFrame(rows, "id string, name string, prompts array<string>, sensitivity double, ord int")


def tab_part(built_in: Column, everyday: Column, count: Column, scored: Column, syncing: Column) -> Column:
    """main, everyday or none: a built-in collection without members is put away once all are scored."""
    nothing = scored & built_in & ~syncing & (count == 0)
    return F.when(nothing, "none").when(everyday, "everyday").otherwise("main")


def hero_candidates(collections: DataFrame, day: int, most: int = 5) -> DataFrame:
    """id of up to ``most`` collections (id, fresh): fresh ones first, shuffled by the day."""
    return collections.orderBy(F.desc("fresh"), F.md5(F.concat("id", F.lit(f":{day}"))), "id").limit(most).select("id")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in an order that the seed decides, the same in every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)
