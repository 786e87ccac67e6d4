"""What a query must return, and cases that are easily lost."""

import pytest

from beaconq.llm import chat, langid, queries, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_ann": "query_id rank vec_id score",
    "op3_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4_langid": "doc_id held_out lang_pred score",
    "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_quality": "doc_id held_out score predicted",
    "op9_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_lexical": "item_id rank doc_id score",
    "op13_bestfit": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(queries.QUERIES[name](spark, SF).columns)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_a_clause_is_read_from_its_first_word():
    m = toxicity.Matcher(toxicity.Grammar())
    near, far = (m.score(f"He said {'word ' * n}you are an idiot") for n in (0, 20_000))
    assert near == far < m.score("you are an idiot")


def test_numerals_are_no_letters():
    assert langid.words_of("² ½ Ⅷ 12") == [] and langid.words_of("Añ² b") == ["añ", "b"]


def templates():
    """Two black boxes, made here so that workers get them whole: one that numbers its
    turns, one whose every output tells how many there are."""

    def numbered(turns):
        return "".join(f"{i}:{role}:{text};" for i, (role, text) in enumerate(turns))

    def folded(turns):
        return f"[{len(turns)}]" + "".join(text for _, text in turns)

    return numbered, folded


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_pieces_are_the_whole_output(n):
    numbered, folded = templates()
    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(n)]
    for template in (numbered, chat.marked_turns):
        renderer = chat.Renderer(template, 4 if getattr(template, "concatenative", False) else None)
        pieces = [renderer.add(*t) for t in turns]
        assert "".join(p[0] for p in pieces) == template(turns)
        assert [p[0][p[1] : p[2]] for p in pieces] == [t for _, t in turns] and not any(p[3] for p in pieces)
    renderer = chat.Renderer(folded)
    assert all(renderer.add(*t)[3] for t in turns)


def test_digests_of_any_template(spark):
    numbered, folded = templates()
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc")], "conv_id long, turn long, role string, text string")
    plain = chat.digests(chat.format_turns(frame, numbered), numbered).first()
    marked = chat.digests(chat.format_turns(frame)).first()
    assert plain["turns_sha256"] == marked["turns_sha256"] and plain["loss_chars"] == marked["loss_chars"] == 2
    assert chat.digests(chat.format_turns(frame, folded), folded).first()["rewrites_history"]
