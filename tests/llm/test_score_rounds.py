"""Texts are scored in rounds: the answers to one round of chunks stand on disk at a time."""

from quillspark.llm import pitman_yor


def test_answers_stand_on_disk_a_round_at_a_time(spark, monkeypatch):
    rows = [(i, i % 10 == 0, f"word {i} and word {i % 7} again") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    fitted = pitman_yor.fit(frame.where("NOT held_out"), sweeps=2)
    rounds, gone, write, discard = [], [], pitman_yor.written, pitman_yor.discard

    def recorded(df, what, *codec):
        out = write(df, what, *codec)
        if what == "answers":
            assert len(gone) == len(rounds)
            rounds.append({r.chunk for r in out.select("chunk").distinct().collect()})
        return out

    def dropped(table):
        gone.append(table.folder)
        discard(table)

    monkeypatch.setattr(pitman_yor, "written", recorded)
    monkeypatch.setattr(pitman_yor, "discard", dropped)
    got = pitman_yor.scores(frame, fitted).collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    assert len(rounds) == pitman_yor.ROUNDS and len(gone) == pitman_yor.ROUNDS
    assert sum(map(len, rounds)) == len(set().union(*rounds)) == 4 and max(map(len, rounds)) == 2
