import random

WORDS = "leave policy days staff report filing annual penalty audit office budget remote security laptop vendor invoice contract renewal notice deadline".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))
