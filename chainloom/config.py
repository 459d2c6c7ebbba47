"""Chains, their tags and limits."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The wire value that asks for the literal tag 0.
LITERAL_ZERO = 4294967295


@dataclass(frozen=True)
class Chain:
    """One (blockchain, network, sidechain) deployment."""

    blockchain: str
    network: str
    sidechain: str | None = None
    stable_tag: int = 1
    latest_tag: int = 1
    stable_event_tag: int = 0
    latest_event_tag: int = 0
    default_stable_event: bool = False
    block_start_height: int = 0
    irreversible_distance: int = 12
    block_time_s: int = 12
    max_block_files: int = 1000
    max_blocks: int = 50
    page_size: int = 50
    max_idle_s: int = 600
    client_rps: int = 2000
    global_rps: int = 3000
    family: str = "evm"
    features: frozenset = field(default_factory=frozenset)

    @property
    def key(self) -> tuple:
        return self.blockchain, self.network, self.sidechain


_CHAINS: dict[tuple, Chain] = {}


def register_chain(chain: Chain) -> Chain:
    """Add or replace a chain."""
    _CHAINS[chain.key] = chain
    return chain


def chain(blockchain: str, network: str = "mainnet", sidechain: str | None = None) -> Chain:
    return _CHAINS[blockchain, network, sidechain]


def chains() -> list[Chain]:
    return list(_CHAINS.values())


for _name in ("ethereum", "bsc", "polygon", "avacchain", "arbitrum", "optimism", "base", "fantom"):
    register_chain(Chain(_name, "mainnet", latest_event_tag=1))
register_chain(Chain("ethereum", "mainnet", "beacon", family="beacon", irreversible_distance=64))
register_chain(Chain("bitcoin", "mainnet", family="bitcoin", irreversible_distance=12, block_time_s=600))
register_chain(Chain("dogecoin", "mainnet", family="rosetta", irreversible_distance=120, block_time_s=60))
register_chain(Chain("solana", "mainnet", stable_tag=2, latest_tag=2, family="solana", irreversible_distance=31, block_time_s=1))
register_chain(Chain("aptos", "mainnet", family="aptos", irreversible_distance=1, block_time_s=1))
#: The chain that the driver's test tables stand for.
TEST_CHAIN = register_chain(Chain("testchain", "local", latest_event_tag=1, max_block_files=5000, max_blocks=500))
