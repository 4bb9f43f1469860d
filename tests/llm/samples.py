"""Made texts."""

import random


def prose(seed, words):
    rng = random.Random(seed)
    syllables = "ta ri no el mu ö ché st and of the in".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))
