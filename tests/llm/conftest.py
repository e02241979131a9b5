import random

import pytest

WORDS = "the of and to in that it for was on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed, words=WORDS):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def german():
    return GERMAN
