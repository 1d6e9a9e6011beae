"""One error type; `code` tells the family: 1 and 2 parse, 3 bind, 4 types, 60 query, 70 storage, 80 transactions."""


class GraphError(Exception):
    def __init__(self, code: int, message: str, hint: str | None = None) -> None:
        self.code, self.hint = code, hint
        super().__init__(f"GL-{code}: {message}" + (f" ({hint})" if hint else ""))
