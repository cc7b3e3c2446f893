"""flowtide: program-flow analytics as Spark DataFrame plans."""

__all__ = ["Engine", "build_session"]


def __getattr__(name):
    if name == "Engine":
        from flowtide.plans.engine import Engine

        return Engine
    if name == "build_session":
        from flowtide.session import build_session

        return build_session
    raise AttributeError(name)
