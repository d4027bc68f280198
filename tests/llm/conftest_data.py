"""What test modules share besides fixtures."""

DATA = "/root/testdata/sf0.001"


def passage(seed: int, n: int) -> str:
    return " ".join(f"word{(seed * 7919 + i * i * 31) % 9973}" for i in range(n))
